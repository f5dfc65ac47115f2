"""Relational operators over the attribute relation and its relatives."""
