"""Importing this module registers every query."""

from . import build_queries, compare_queries, job_queries, parsing_queries

__all__ = ["build_queries", "compare_queries", "job_queries", "parsing_queries"]
