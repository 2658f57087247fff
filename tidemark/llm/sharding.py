"""Reproducible shuffle into shards by a Feistel permutation over global row numbers.

Rows are numbered 0..n-1 in the order of the id (then size and checksum, so that the numbering
depends on the data alone). A keyed Feistel network permutes a rectangle that is barely larger than
n; values that fall outside are permuted again (cycle walking) until they are inside. The permuted
number gives the shard (remainder) and the slot (quotient), so shard sizes differ by at most one row
and slots have no gaps. ``locate`` computes both for one row number without any data.

Everything is DataFrame functions. The numbering needs one range shuffle of small rows and one count
per partition; no task sees more than its range.

Null text has size 1 and the checksum of the empty text. Null ids come first; rows that are equal in
id, size and checksum are numbered next to each other in either order. Only the id and text columns
are read. An empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, field, unicode_text

SHARDS = 8
ROUNDS = 6
SEED = 20240521
#: The round function computes modulo this prime, so that no product leaves 64 bits.
_PRIME = (1 << 31) - 1


def round_keys(seed: int, rounds: int = ROUNDS) -> list[tuple[int, int, int]]:
    """Three numbers below the prime for each round, from a linear congruence."""
    state, keys = seed % _PRIME, []
    for _ in range(rounds):
        three = []
        for _ in range(3):
            state = (state * 48271 + 11) % _PRIME
            three.append(state)
        keys.append((three[0] or 1, three[1], three[2]))
    return keys


def rectangle(n: int) -> tuple[int, int]:
    """Sides of the permuted rectangle: at least n cells, and fewer than its long side too many."""
    rows = max(1, math.isqrt(max(n, 1) - 1) + 1)
    return rows, max(1, -(-n // rows))


def _mixed(x, a: int, b: int, c: int):
    y = (x * a + b) % _PRIME
    return (y * y + c) % _PRIME


def permuted_number(number: Column, n: int, seed: int = SEED) -> Column:
    """The permuted place of a row number in 0..n-1."""
    if n >= 1 << 53:
        raise ValueError("too many rows")
    rows, columns = rectangle(n)
    keys = round_keys(seed)
    rounds = F.array(*[F.struct(*[F.lit(x).cast("long").alias(c) for c, x in zip("abcdef", (*keys[i], *keys[i + 1]), strict=True)]) for i in range(0, len(keys), 2)])

    def both(state: Column, key: Column) -> Column:
        left = (state.left + _mixed(state.right, key.a, key.b, key.c)) % rows
        return F.struct(left.alias("left"), ((state.right + _mixed(left, key.d, key.e, key.f)) % columns).alias("right"))

    def once(value: Column) -> Column:
        left = value % rows
        start = F.struct(left.cast("long").alias("left"), ((value - left) / rows).cast("long").alias("right"))
        return F.aggregate(rounds, start, both, lambda s: s.right * rows + s.left)

    def walk(value: Column, times: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(times)), value, lambda v, i: F.when(v < n, v).otherwise(once(v)))

    # A walk steps on an outside cell at most once, so it ends after as many steps as there are such
    # cells, fewer than a side. That is nearly always the first few: the rest is only for a row that
    # is still outside after them.
    outside = rows * columns - n
    walked = once(number.cast("long"))
    for times in (min(outside, 64), outside) if outside else ():
        walked = F.transform(F.array(walked), lambda v, k=times: F.when(v < n, v).otherwise(walk(v, k)))[0]
    return walked


def locate(number: int, n: int, shards: int = SHARDS, seed: int = SEED) -> tuple[int, int]:
    """Shard and slot of one row number, by plain arithmetic."""
    rows, columns = rectangle(n)
    keys, value = round_keys(seed), number
    while True:
        left, right = value % rows, value // rows
        for i in range(0, len(keys), 2):
            left = (left + _mixed(right, *keys[i])) % rows
            right = (right + _mixed(left, *keys[i + 1])) % columns
        value = right * rows + left
        if value < n:
            return value % shards, value // shards


def numbered(rows: DataFrame, order: list) -> tuple[DataFrame, int]:
    """Add ``row_number`` from 0 in the given order; the number of rows."""
    ranged = (
        rows.repartitionByRange(*map(field, order))
        .sortWithinPartitions(*map(field, order))
        .withColumn("part", F.spark_partition_id())
        .withColumn("within", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    ranged = cut(ranged)  # read twice; the numbers must be the same both times
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row per partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    n = counts.agg(F.sum("n")).first()[0] or 0
    # broadcast: a row per range partition, a number that the session's settings bound
    return ranged.join(F.broadcast(starts), "part").withColumn("row_number", F.col("within") + F.col("before")).drop("part", "within", "before"), n


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``size``, ``text_crc32``, ``row_number``, ``shard``, ``slot``."""
    text = unicode_text(text_col)
    rows, n = numbered(
        docs.select(
            field(id_col),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        ),
        [id_col, "size", "text_crc32"],
    )
    return (
        rows.withColumn("place", permuted_number(F.col("row_number"), n, seed))
        .withColumn("shard", (F.col("place") % shards).cast("int"))
        .withColumn("slot", ((F.col("place") - F.col("shard")) / shards).cast("long"))
        .drop("place")
    )
