"""Dealing out fits: rows that are small in bytes but long in work get tasks of their own.

Adaptive execution joins partitions by their bytes; an explicit number of partitions it leaves alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.storage import cut

#: Tasks at most; beyond, a task has several fits.
TASKS = 10_000
#: Bytes of packed runs that are broadcast; beyond, each fit carries its run through the shuffle.
BROADCAST_BYTES = 64 << 20


def dealt(rows: DataFrame, n: int, batch: int = 1) -> DataFrame:
    """``rows``, of which there are about ``n``, dealt out ``batch`` to a task."""
    return rows.repartition(max(1, min(TASKS, -(-n // batch))))


def with_tasks(packed: DataFrame, keys: list[str], tasks: list[dict], row_bytes: int) -> DataFrame:
    """(keys, rows, member, task fields): a row and a task for each run and member. ``packed`` has the
    run's data in the array ``rows``, of about ``row_bytes`` an element."""
    names = list(tasks[0])
    table = F.explode(F.array(*[F.struct(F.lit(i).alias("member"), *[F.lit(t[k]).alias(k) for k in names]) for i, t in enumerate(tasks)])).alias("_task")
    packed = cut(packed)
    size = packed.agg(F.count("*").alias("runs"), F.coalesce(F.sum(F.size("rows")), F.lit(0)).alias("rows")).first()
    n = size["runs"] * len(tasks)
    if size["rows"] * row_bytes <= BROADCAST_BYTES:
        asked = dealt(packed.select(*keys, table).select(*keys, "_task.*"), n)
        return asked.join(F.broadcast(packed), keys).select(*keys, "rows", "member", *names)
    return dealt(packed.select(*keys, "rows", table).select(*keys, "rows", "_task.*"), n)
