"""Readers and writers. Readers take explicit schemas; writers keep column order."""
