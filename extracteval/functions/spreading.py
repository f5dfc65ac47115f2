"""Dealing rows out to as many tasks as their number asks for."""

from __future__ import annotations

from pyspark.sql import DataFrame

TASK_ROWS = 250_000  # rows that one task groups, about
MOST_TASK_ROWS = 1_500_000  # and before there are more than DIRECT_TASKS
DIRECT_TASKS = 200  # above that, whoever deals the rows out sorts them by task in memory
FEW_ROWS = 10_000  # not worth a task of their own
MOST_TASKS = 10_000


def tasks_for(rows: int, cores: int) -> int:
    """How many tasks that many rows are dealt to."""
    return min(max(rows // TASK_ROWS + 1, min(cores, rows // FEW_ROWS + 1)), MOST_TASKS)


def deal(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """``rows``, ``n`` of them or about as many, dealt out by hash of the keys. Grouping by the keys,
    or by them and more columns, needs no other shuffle.

    A file's row group goes to one task and adaptive execution merges partitions by their packed
    bytes, so attributes that pack well would meet in one task's hash table by the million; rows dealt
    to a given number of tasks are not merged again. Up to ``DIRECT_TASKS`` tasks the rows go straight
    to files; beyond, a task that reads a row group holds all rows it makes of it, so the tasks become
    larger before they become more."""
    tasks = tasks_for(n, rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(min(tasks, max(DIRECT_TASKS, n // MOST_TASK_ROWS + 1)), *keys)
