"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII characters. A window
is ten consecutive words of a benchmark item; a shorter item is one window. All windows form one
automaton over word numbers; each document runs through it once, and matched words are mapped back
to character offsets of the original text.

The benchmark is broadcast in blocks whose automata are estimated, by the words of their windows, at
``block_bytes`` or less; a worker process builds a block's automaton once and uses it for all of its
tasks. A larger benchmark is split by a hash of its distinct rows and the documents, written once, are
read by the blocks' automata one after the other; a pass writes its hits only, and results are the
same. The driver holds one block at a time. An item that is larger than a block is a block of its own.

Null or word-free texts have no words and no hits; items without words have no windows. A null item
id is named ``null``. Repeated items and ids count once in ``items``. Documents' null or repeated
ids and repeated rows go through row for row; ``carry`` keeps the input row untouched as a struct,
so clashing names do no harm. An empty table gives an empty table; an empty benchmark hits nothing.
"""

from __future__ import annotations

import math
import re
import uuid
from itertools import repeat

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, field, rows_of, slices, staged, unicode_text, whole_row

WINDOW = 10
#: Estimated bytes of the automaton that one worker process holds at once.
BLOCK_BYTES = 256 << 20
#: Bytes of one of the automaton's nodes, of which a window has one a word.
NODE_BYTES = 56
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Bytes to word bytes: A-Z fall to a-z; digits, a-z and all bytes of non-ASCII stay; others part words (as spaces).
_FOLD = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256)
)


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


class Matcher:
    """The automaton of a list of (item id, text)."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], str | set[str]] = {}  # most windows are of one item
        for item, raw in items:
            ids = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(raw))
            size = min(window, len(ids))
            for start in range(len(ids) - size + 1 if size else 0):
                key = ids[start : start + size]
                own = owners.setdefault(key, item)
                if isinstance(own, set):
                    own.add(item)
                elif own != item:
                    owners[key] = {own, item}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        self.any, shared = bool(owners), {}
        while owners:  # each goes once it is in
            key, own = owners.popitem()
            value = (len(key), tuple(sorted(own)) if isinstance(own, set) else (own,))
            self.automaton.add_word(key, shared.setdefault(value, value))
        if self.any:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit word ranges (first, end), apart and in order, and the items with a window here."""
        if not self.any or not words:
            return [], set()
        ids = tuple(map(self.numbers.get, words, repeat(0)))
        found, items = [], set()
        for end, (size, own) in self.automaton.iter(ids):
            found.append((end - size + 1, end + 1))
            items.update(own)
        return merged(found), items


def merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word ranges (first, end) in order; those that touch become one."""
    ranges: list[tuple[int, int]] = []
    for first, end in sorted(found):
        if ranges and first <= ranges[-1][1]:
            ranges[-1] = (ranges[-1][0], max(end, ranges[-1][1]))
        else:
            ranges.append((first, end))
    return ranges


def items_of(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, window: int = WINDOW) -> tuple[DataFrame, int]:
    """Distinct (item, text, block) rows and the number of blocks, whose automata are each estimated at
    about ``block_bytes`` at most."""
    rows = benchmark.select(F.coalesce(field(item_col).cast("string"), F.lit("null")).alias("item"), unicode_text(text_col).alias("text")).where("text <> ''").distinct()
    words = n_words("text")
    size = F.least(words, F.lit(window))
    total = rows.agg(F.sum(F.octet_length("text") + 16 + NODE_BYTES * size * (words - size + 1))).first()[0] or 0
    n = max(1, math.ceil(1.5 * total / block_bytes)) if total > block_bytes else 1
    return rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n))), n


def find(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, carry: bool = False,
) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit``, ``items`` (sorted item ids) and ``spans``
    (character ranges of the original text, one for each run of hit words); with ``carry``, also
    the input row as the struct ``row``."""
    held = [field(id_col).alias("id"), *([whole_row(docs)] if carry else [])]
    rows = docs.select(*held, unicode_text(text_col).alias("text"))
    items, blocks = items_of(benchmark, item_col, item_text_col, block_bytes, window)
    if blocks > 1:
        return _in_blocks(rows, items, blocks, window).withColumnRenamed("id", id_col)
    return _shown(_pass(rows, _fetched(items), window)[0]).withColumnRenamed("id", id_col)


def _fetched(items: DataFrame) -> list[tuple[str, bytes]]:
    """The items of one block, which is of bounded size."""
    return [(r["item"], r["text"].encode()) for r in items.select("item", "text").toLocalIterator()]


def _in_blocks(rows: DataFrame, items: DataFrame, blocks: int, window: int) -> DataFrame:
    """The documents are written once, with a number, and read once a block. A block is fetched, used
    and released before the next; what a pass writes are the documents it hits."""
    rows = staged(rows.withColumn("rid", F.monotonically_increasing_id()), "decontaminate")
    items, found = cut(items), None
    for k in range(blocks):
        hits, shared = _pass(rows.select("rid", "text"), _fetched(items.where(F.col("block") == k)), window)
        hits = staged(hits.where(F.size("items") > 0), "decontaminate-hits")
        shared.destroy()
        found = hits if found is None else found.union(hits)
    # a document has at most one row a block
    found = found.groupBy("rid").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("ranges")).alias("ranges"))
    counted = rows.select(*[c for c in rows.columns if c != "text"], n_words("text").alias("n_words"))
    joined = counted.join(found, "rid", "left").drop("rid")
    return _shown(joined.withColumn("items", F.coalesce("items", F.array())).withColumn("ranges", _united(F.coalesce("ranges", F.array()))))


def n_words(column: str) -> Column:
    return F.size(F.regexp_extract_all(F.col(column), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))).cast("long")


def _united(ranges: Column) -> Column:
    """Ranges of several passes, in order, those that touch as one."""
    put = lambda acc, r: F.concat(acc, F.array(r))
    last = lambda acc: F.element_at(acc, -1)
    join = lambda acc, r: F.struct(last(acc)["first"].alias("first"), F.greatest(last(acc)["end"], r["end"]).alias("end"), last(acc)["start"].alias("start"), F.greatest(last(acc)["stop"], r["stop"]).alias("stop"))
    step = lambda acc, r: F.when((F.size(acc) > 0) & (r["first"] <= F.try_element_at(acc, F.lit(-1))["end"]), put(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), join(acc, r))).otherwise(put(acc, r))
    return F.aggregate(F.array_sort(ranges), F.lit([]).cast(_RANGES), step)


def _shown(found: DataFrame) -> DataFrame:
    kept = [c for c in found.columns if c in ("id", "row")]
    n_hit = F.aggregate("ranges", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    spans = F.transform("ranges", lambda r: F.struct(r["start"].alias("start"), r["stop"].alias("end")))
    return found.select(*kept, "n_words", n_hit.alias("n_hit"), F.array_sort(F.array_distinct("items")).alias("items"), spans.alias("spans"))


def _pass(rows: DataFrame, block: list[tuple[str, bytes]], window: int) -> tuple[DataFrame, Broadcast]:
    """The rows without their text, with ``n_words``, ``items`` and ``ranges`` of one block; and the
    broadcast block."""
    shared, name = rows.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex
    kept = [c for c in rows.columns if c != "text"]

    def run(batches):
        matcher = _matcher(name, shared, window)
        for batch in slices(batches, "text"):
            items, ranges, many = [], [], []
            for raw in batch.column("text").cast(pa.binary()).to_pylist():
                words = words_of(raw)
                hit, own = matcher.scan(words)
                items.append(sorted(own))
                ranges.append(_in_characters(raw, hit) if hit else [])
                many.append(len(words))
            told = [pa.array(many, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(ranges, _ARROW_RANGES)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *told], names=[*kept, "n_words", "items", "ranges"])

    schema = T.StructType([rows.schema[c] for c in kept]).add("n_words", "long").add("items", T.ArrayType(T.StringType())).add("ranges", _RANGES)
    return rows.mapInArrow(run, schema), shared


#: The last automaton of this worker process by the name of its block: tasks that follow in the process
#: use it, and the next block replaces it, so that a process holds one.
_HELD: dict[str, Matcher] = {}


def _matcher(block: str, shared: Broadcast, window: int) -> Matcher:
    if block not in _HELD:
        _HELD.clear()
        _HELD[block] = Matcher(shared.value, window)
    return _HELD[block]


_PLACES = ("first", "end", "start", "stop")
_RANGES = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in _PLACES]))
_ARROW_RANGES = pa.list_(pa.struct([(c, pa.int64()) for c in _PLACES]))


def _in_characters(raw: bytes, ranges: list[tuple[int, int]]) -> list[dict]:
    """Word ranges with the characters they cover."""
    places = [m.span() for m in _WORD.finditer(raw.decode().translate(_UPPER))]
    return [{"first": a, "end": b, "start": places[a][0], "stop": places[b - 1][1]} for a, b in ranges]


_UPPER = {c: c + 32 for c in range(0x41, 0x5B)}


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(
        field(id_col),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without any hit, with the input's columns."""
    return rows_of(find(docs, benchmark, carry=True, **how).where("n_hit = 0"), docs)
