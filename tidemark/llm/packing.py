"""Best-fit packing of tokenised documents by the linear grouping scheme.

1. Every document becomes its ids plus an end id; only documents longer than the capacity are cut,
   and only their first piece may be shorter than the capacity.
2. The plan is made from the histogram of piece lengths alone. It has at most as many rows as the
   capacity has values, so it and the plan stay small whatever the corpus. Large lengths are dealt
   into groups of equal cardinality and rounded up to their group's largest; the few sizes that are
   left are packed by configurations (column generation over the linear programme, rounded down,
   the rest first-fit). The actual documents take the places of their group, longest first, and
   small pieces then go best-fit into what is left.
3. Pieces are numbered within their length from counts of each written partition, and look up
   their place in the broadcast plan. No length, however common, meets in one task.

Null text counts as empty (one end id). Null or repeated ids and repeated rows are packed like any
other row. Only the id and text columns are read. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bpe
from tidemark.llm.common import cut, field, slices, unicode_text

CAPACITY = 2048
#: Groups of equal cardinality that the large lengths are rounded to.
GROUPS = 48
#: Lengths above this share of the capacity are large.
LARGE = 1 / 8

PLAN = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("plan_length", "lo", "hi", "first_sequence", "per_sequence", "first_offset")]
)


#: What a piece is told beside its document's id.
_PIECE = T.StructType().add("piece", "integer").add("start", "long").add("length", "long").add("ids_crc32", "long").add("task", "integer").add("nth", "long")


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, ``piece``, ``start``, ``length``, ``ids_crc32``, the task that made
    it (``task``) and its number among that task's pieces of the same length (``nth``)."""

    def run(batches):
        encoder, seen = bpe.Encoder(bpe.vocabulary(path)), defaultdict(int)
        task = TaskContext.get().partitionId()
        for batch in slices(batches, "text"):
            took, rows = [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encoder.ids(text), end_id], "<u4")
                first = (len(ids) - 1) % capacity + 1
                edges = [0, *range(first, len(ids) + 1, capacity)]
                for k in range(len(edges) - 1):
                    length = edges[k + 1] - edges[k]
                    took.append(i)
                    rows.append((k, edges[k], length, zlib.crc32(ids[edges[k] : edges[k + 1]].tobytes()), task, seen[length]))
                    seen[length] += 1
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(took, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["id", *(f.name for f in _PIECE)],
            )

    rows = docs.select(field(id_col).alias("id"), unicode_text(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], *_PIECE])).withColumnRenamed("id", id_col)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset`` there."""
    return place(cut(pieces(docs, path, capacity, end_id, id_col, text_col)), capacity)


def place(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give rows of ``pieces`` (materialised, as they are read twice) their sequences."""
    spark = made.sparkSession
    counts = made.groupBy("task", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    plan = spark.createDataFrame(make_plan(histogram, capacity), PLAN)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    numbered = (
        made.join(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), ["task", "length"])
        .withColumn("rank", F.col("nth") + F.col("before"))
    )
    at = F.col("rank") - F.col("lo")
    return numbered.join(
        F.broadcast(plan),
        (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")),
    ).select(
        *[field(c) for c in made.columns if c not in ("task", "nth")],
        (F.col("first_sequence") + F.floor(at / F.col("per_sequence"))).alias("sequence_id"),
        (F.col("first_offset") + at % F.col("per_sequence") * F.col("length")).alias("offset"),
    )


class _Plan:
    """Runs of like sequences, and which ranks of each length go where."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.next_rank = dict.fromkeys(histogram, 0)
        self.open: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: (first sequence, how many)

    def new(self, many: int) -> int:
        self.sequences += many
        return self.sequences - many

    def put(self, length: int, count: int, first: int, per: int, offset: int) -> None:
        lo = self.next_rank[length]
        self.next_rank[length] = lo + count
        self.rows.append((length, lo, lo + count, first, per, offset))

    def configuration(self, slots: list[list[tuple[int, int]]], many: int) -> None:
        """``many`` sequences; each slot has runs (length, how many) that sum to ``many``."""
        first, place, left = self.new(many), 0, [[list(run) for run in slot] for slot in slots]
        while place < many:
            step = min(slot[0][1] for slot in left)
            offset = 0
            for slot in left:
                self.put(slot[0][0], step, first + place, 1, offset)
                offset += slot[0][0]
                slot[0][1] -= step
                if not slot[0][1]:
                    slot.pop(0)
            self.open[self.capacity - offset].append((first + place, step))
            place += step

    def best_fit(self, length: int, count: int) -> None:
        """The same as placing one by one into the fullest sequence with room."""
        rooms = sorted(room for room, runs in self.open.items() if room >= length and runs)
        while count:
            while rooms and not self.open[rooms[0]]:
                rooms.pop(0)
            if not rooms:
                many = math.ceil(count / (self.capacity // length))
                self.open[self.capacity].append((self.new(many), many))
                rooms = [self.capacity]
            room = rooms[0]
            first, many = self.open[room].pop()
            per = min(room // length, count)
            full = min(many, count // per)
            self.put(length, full * per, first, per, self.capacity - room)
            self.open[room - per * length].append((first, full))
            if many > full:
                self.open[room].append((first + full, many - full))
            count -= full * per
            if (rest := room - per * length) >= length and rest not in rooms:
                rooms = sorted({*rooms, rest})


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, int, int, int, int, int]]:
    """(length, lo, hi, first sequence, pieces per sequence, first offset): ranks ``lo..hi - 1`` of
    that length fill sequences from the first on, that many in each, from that offset on."""
    plan = _Plan(histogram, capacity)
    large = sorted(((n, c) for n, c in histogram.items() if capacity * LARGE < n <= capacity), reverse=True)
    if large and large[0][0] == capacity:
        plan.configuration([[large[0]]], large[0][1])
        large = large[1:]
    dealt = _equal_groups(large, groups)
    sizes = [group[0][0] for group in dealt]
    wanted = [sum(c for _, c in group) for group in dealt]
    for counts, many in _configurations(sizes, wanted, capacity):
        slots = [_take(dealt[g], many) for g, times in enumerate(counts) for _ in range(times)]
        plan.configuration(slots, many)
    for group in dealt:  # what rounding down has left: best-fit, longest first
        for length, count in group:
            plan.best_fit(length, count)
    for length, count in sorted(((n, c) for n, c in histogram.items() if n <= capacity * LARGE), reverse=True):
        plan.best_fit(length, count)
    return plan.rows


def _equal_groups(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Runs (length, count), longest first, dealt into groups of equal count; a length may be split."""
    each = max(1, math.ceil(sum(c for _, c in lengths) / groups))
    dealt: list[list[tuple[int, int]]] = []
    room = 0
    for length, count in lengths:
        while count:
            if not room:
                dealt.append([])
                room = each
            took = min(room, count)
            dealt[-1].append((length, took))
            room, count = room - took, count - took
    return dealt


def _take(group: list[tuple[int, int]], many: int) -> list[tuple[int, int]]:
    """Remove the longest ``many`` from a group."""
    took = []
    while many:
        length, count = group.pop(0)
        n = min(count, many)
        took.append((length, n))
        many -= n
        if count > n:
            group.insert(0, (length, count - n))
    return took


def _configurations(sizes: list[int], wanted: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Configurations of the linear programme's best solution, with how many of each, rounded down."""
    k = len(sizes)
    if not k:
        return []
    size, need = np.array(sizes), np.array(wanted, float)
    columns = np.diag(capacity // size).astype(float)
    for _ in range(40 * k):
        inverse = np.linalg.inv(columns)
        used = inverse @ need
        worth = np.ones(k) @ inverse
        entering, value = _knapsack(size, worth, capacity)
        if value <= 1 + 1e-6:
            break
        change = inverse @ entering
        ratio = np.where(change > 1e-9, np.maximum(used, 0) / np.where(change > 1e-9, change, 1), np.inf)
        columns[:, int(ratio.argmin())] = entering
    used, left, found = np.linalg.inv(columns) @ need, need.astype(int), []
    for j in np.argsort(-used):
        counts = columns[:, j].astype(int)
        many = min([max(int(used[j] + 1e-9), 0), *(left[i] // counts[i] for i in np.flatnonzero(counts))])
        if many:
            left -= counts * many
            found.append((counts.tolist(), int(many)))
    return found


def _knapsack(size: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The configuration of most worth."""
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    order = np.argsort(size)
    ordered, value = size[order], worth[order]
    for room in range(int(ordered[0]), capacity + 1):
        m = int(np.searchsorted(ordered, room, "right"))
        gains = best[room - ordered[:m]] + value[:m]
        i = int(gains.argmax())
        best[room], pick[room] = (gains[i], order[i]) if gains[i] > best[room - 1] else (best[room - 1], -1)
    counts, room = np.zeros(len(size)), capacity
    while room > 0:
        if pick[room] < 0:
            room -= 1
            continue
        counts[pick[room]] += 1
        room -= int(size[pick[room]])
    return counts, float(best[capacity])
