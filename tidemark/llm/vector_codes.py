"""Product codes of vectors in exact integers, trained on Hilbert-sorted blocks.

Each component x becomes floor(4096 * x), and a vector is cut into equal consecutive parts. The parts
of each position are sorted along a Hilbert curve and cut into flat blocks of ``BLOCK`` rows, which
are written once with their box (least and greatest value of each component) and their sums. A round
of training measures the distance of each box to each codebook entry: an entry whose nearest point of
the box is farther than another entry's farthest point can win no row of it. What is left is the
block's shortlist. With one entry the block gives its stored sums at once; otherwise a small integer
kernel finds the nearest entry of the shortlist for each row. Tasks return sums and counts by
position and entry, at most positions x entries rows, and the driver makes the next codebooks.

All arithmetic is in 64-bit integers; ties go to the lower entry. The codebooks start with the parts
of the smallest ids (null ids last, then by the vector), fewer if there are fewer rows. Dropped are
rows whose vector is null, empty or holds null or non-finite components, those with a component of
32768 or more in size (their squares would leave the integers), and those whose length isn't that of
the row with the smallest id. That length must be a multiple of the parts, or an error is raised.
Repeated rows and ids are rows of their own. Null labels count as equal. Only the id, vector and
label columns are read, so other columns may have any name. An empty table gives an empty table.

Equal vectors have the same place on the curve and are told apart by a row number, so that a vector
that is very common is dealt out over many blocks and tasks.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, field, staged

SCALE = 4096
#: Greatest size of an integer component, so that squared distances fit 64 bits.
MOST = 1 << 27
BLOCK = 128
PARTS = 8
ENTRIES = 16
ROUNDS = 6
#: Labels up to this number are joined by broadcast.
FEW_LABELS = 100_000


@dataclass
class Codebooks:
    """``entries``: (part, entry, component) integers; ``counts``: rows of each entry when last assigned."""

    entries: np.ndarray

    def text(self) -> str:
        return ",".join(map(str, self.entries.reshape(-1).tolist()))

    def sha256(self) -> str:
        return hashlib.sha256(self.text().encode()).hexdigest()


def hilbert(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Places along a Hilbert curve of integer points between ``low`` and ``high``, as 63-bit integers.
    Up to 63 components take part, with as many bits each as fit, 8 at most."""
    points, low, high = points[:, :63], low[:63], high[:63]
    m = points.shape[1]
    bits = max(1, min(8, 63 // m))
    width = np.maximum(high - low, 1).astype(np.float64)
    x = np.clip((points - low) / width * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
    # from axes to the transposed curve index: undo rotations from the top bit down, then Gray-encode
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(m):
            on = (x[:, i] & q) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] ^= np.where(on, p, swap)
            if i:
                x[:, i] ^= swap
        q >>= 1
    for i in range(1, m):
        x[:, i] ^= x[:, i - 1]
    turn = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[:, -1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn[:, None]
    place = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(m):
            place = (place << 1) | ((x[:, i] >> b) & 1)
    return place


def shortlists(low: np.ndarray, high: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """(block, entry): whether an entry may be the nearest of some point of the box."""
    nearest = np.maximum(np.maximum(low[:, None] - entries, entries - high[:, None]), 0)
    farthest = np.maximum(np.abs(entries - low[:, None]), np.abs(entries - high[:, None]))
    nearest, farthest = (nearest * nearest).sum(-1), (farthest * farthest).sum(-1)
    return nearest <= farthest.min(1)[:, None]


def nearest(rows: np.ndarray, entries: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each row among the allowed entries; ties to the lower one."""
    apart = rows[:, None] - entries[allowed]
    apart = (apart * apart).sum(-1)
    best = apart.argmin(1)
    return allowed[best], apart[np.arange(len(rows)), best]


def integers(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(rid, id, label, v): the rows that take part, with integer components."""
    v = F.transform(field(vector_col).cast("array<double>"), lambda x: F.floor(x * SCALE))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < MOST // SCALE)
    rows = table.where(F.coalesce((F.size(field(vector_col)) > 0) & F.forall(field(vector_col), fine), F.lit(False)))
    rows = rows.select(F.monotonically_increasing_id().alias("rid"), field(id_col).alias("id"), field(label_col).alias("label"), v.alias("v"))
    return staged(rows, "vectors")


def _blocks(rows: DataFrame, size: int, parts: int) -> DataFrame:
    """A row per block: part, count, rids, the matrix, its box and its sums (64-bit integers)."""
    m = size // parts
    ends = rows.agg(*[f(F.col("v")[i]) for f in (F.min, F.max) for i in range(size)]).first()
    low, high = np.array(ends, np.int64).reshape(2, parts, m) if ends[0] is not None else np.zeros((2, parts, m), np.int64)

    def split(batches):
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, parts, m)
            for p in range(parts):
                own = np.ascontiguousarray(v[:, p])
                packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * m), len(own), [None, pa.py_buffer(own.astype("<i8").tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(own), p, np.int32)), pa.array(hilbert(own, low[p], high[p])), batch.column("rid"), packed.cast(pa.binary())], names=["part", "place", "rid", "x"]
                )

    def block(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        part = None

        def made():
            rid = np.concatenate([h[0] for h in held])
            x = np.concatenate([h[1] for h in held])
            held.clear()
            return [part, len(rid), rid.astype("<i8").tobytes(), x.tobytes(), np.stack([x.min(0), x.max(0), x.sum(0)]).tobytes()]

        names = ["part", "n", "rids", "x", "box"]
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            out = []
            parts_of = batch.column("part").to_numpy()
            rid = batch.column("rid").to_numpy()
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), "<i8").reshape(-1, m)
            edges = [0, *(np.flatnonzero(np.diff(parts_of)) + 1).tolist(), len(parts_of)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if held and parts_of[a] != part:
                    out.append(made())
                part = int(parts_of[a])
                while a < b:
                    take = min(b - a, BLOCK - sum(len(h[0]) for h in held))
                    held.append((rid[a : a + take], x[a : a + take]))
                    a += take
                    if sum(len(h[0]) for h in held) == BLOCK:
                        out.append(made())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(made(), kinds, strict=True)], names=names)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flat = rows.select("rid", "v").mapInArrow(split, "part int, place long, rid long, x binary")
    flat = flat.repartitionByRange(tasks, "part", "place", "rid").sortWithinPartitions("part", "place", "rid")
    return staged(flat.mapInArrow(block, "part int, n int, rids binary, x binary, box binary"), "vector-blocks")


def _opened(batch: pa.RecordBatch, m: int):
    """(part, rids, matrix, sums, shortlist) of each block of a batch is found from these arrays."""
    box = np.frombuffer(b"".join(batch.column("box").to_pylist()), "<i8").reshape(-1, 3, m)
    return batch.column("part").to_numpy(), box


def _round(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one assignment of all rows."""
    parts, k, m = books.shape

    def run(batches):
        sums, counts = np.zeros((parts, k, m), np.int64), np.zeros((parts, k), np.int64)
        for batch in batches:
            part, box = _opened(batch, m)
            sizes, matrices = batch.column("n").to_numpy(), batch.column("x")
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                short = shortlists(box[at, 0], box[at, 1], books[p])
                for i, on in zip(at.tolist(), short, strict=True):
                    allowed = np.flatnonzero(on)
                    if len(allowed) == 1:
                        sums[p, allowed[0]] += box[i, 2]
                        counts[p, allowed[0]] += sizes[i]
                        continue
                    x = np.frombuffer(matrices[i].as_py(), "<i8").reshape(-1, m)
                    code, _ = nearest(x, books[p], allowed)
                    np.add.at(sums[p], code, x)
                    counts[p] += np.bincount(code, minlength=k)
        used = np.argwhere(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used[:, 0].astype(np.int32)),
                pa.array(used[:, 1].astype(np.int32)),
                pa.array(counts[tuple(used.T)]),
                pa.array(sums[tuple(used.T)].tolist(), pa.list_(pa.int64())),
            ],
            names=["part", "entry", "n", "sums"],
        )

    found = blocks.mapInArrow(run, "part int, entry int, n long, sums array<long>")
    total = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(m)])
    new = books.copy()
    for r in total.collect():  # at most parts x entries rows
        new[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(m)]
    return new


def _assigned(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(rid, part, entry, error) of all rows."""
    m = books.shape[2]

    def run(batches):
        for batch in batches:
            part, box = _opened(batch, m)
            rids, matrices = batch.column("rids"), batch.column("x")
            out = [[], [], [], []]
            for i, p in enumerate(part.tolist()):
                allowed = np.flatnonzero(shortlists(box[i : i + 1, 0], box[i : i + 1, 1], books[p])[0])
                code, error = nearest(np.frombuffer(matrices[i].as_py(), "<i8").reshape(-1, m), books[p], allowed)
                for held, new in zip(out, (np.frombuffer(rids[i].as_py(), "<i8"), np.full(len(code), p, np.int32), code.astype(np.int32), error), strict=True):
                    held.append(new)
            kinds = [np.int64, np.int32, np.int32, np.int64]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*h, np.empty(0, k)]).astype(k)) for h, k in zip(out, kinds, strict=True)], names=["rid", "part", "entry", "error"])

    return blocks.mapInArrow(run, "rid long, part int, entry int, error long")


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """The written blocks of ``integers`` rows and the codebooks after all rounds."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(1).collect()
    size = len(first[0]["v"]) if first else parts
    if size % parts:
        raise ValueError(f"vectors of {size} components can't be cut into {parts} equal parts")
    rows = rows.where(F.size("v") == size)
    start = rows.orderBy(F.col("id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = np.array([r["v"] for r in start], np.int64).reshape(-1, parts, size // parts).swapaxes(0, 1).copy()
    blocks = _blocks(rows, size, parts)
    for _ in range(rounds if len(start) else 0):
        books = _round(blocks, books)
    return blocks, Codebooks(books)


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """(id, label, ``code`` array of entry numbers, ``error``) for each row that takes part, and the codebooks."""
    rows = integers(table, id_col, vector_col, label_col)
    blocks, books = train(rows, parts, entries, rounds)
    found = _assigned(blocks, books.entries)
    coded = found.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("part", "entry"))).alias("c"), F.sum("error").alias("error"))  # one row a part
    coded = coded.select("rid", F.col("c.entry").alias("code"), "error")
    return cut(rows.select("rid", "id", "label").join(coded, "rid").select(F.col("id").alias(id_col), F.col("label").alias(label_col), "code", "error")), books


def with_label_error(coded: DataFrame, label_col: str = "label") -> DataFrame:
    """The rows with ``label_error``, the errors summed over equal labels (nulls together). A label that
    most rows have is summed before it is shuffled, and never gathers its rows in one task."""
    label = field(label_col)
    totals = cut(coded.groupBy(label.alias("__label")).agg(F.sum("error").alias("label_error")))
    if totals.count() <= FEW_LABELS:
        totals = F.broadcast(totals)
    return coded.join(totals, label.eqNullSafe(F.col("__label")), "left").drop("__label")


def code_text(code_col: str = "code"):
    """The entries in the order of the parts, two hex digits each."""
    return F.array_join(F.transform(field(code_col), lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
