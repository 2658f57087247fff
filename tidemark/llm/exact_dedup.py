"""Exact deduplication by deterministic block naming.

Texts are compared after every run of space, tab, line feed, vertical tab, form feed and carriage
return has become one space. Fixed-size blocks of the normalised text are sorted and named by
integers, then adjacent pairs of names are named, level by level, until each text has one name.
Two texts have the same level and name exactly when they are equal: no hash decides, so there are
no collisions.

Before anything is shuffled, each Arrow batch keeps one copy of texts that are equal within it, so
a text that fills a third of the table enters the naming at most once per batch. Names are ranks of
distinct blocks and pairs inside hash buckets, so a header that all documents share is ranked once
(equal ones meet before the shuffle); a block's bytes are shuffled once. Places find their names by
hash only where the ranking has shown that one key has that hash.

Null text counts as empty. Repeated rows are documents of their own; of equal rows with equal (or
null) ids exactly one stays. Null ids are never smaller than another id. Only the id and text
columns are read, and ``carry`` columns go through untouched, so clashing names do no harm. An
empty table gives an empty table. A long text is held by one task at a time.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, field, rows_of, slices, staged, unicode_text, whole_row

BLOCK_BYTES = 4096
#: Hash buckets in which blocks and pairs are ranked; names are bucket * 2**40 + rank.
BUCKETS = 1 << 20
_SPACE = b" \t\n\v\f\r"


def normalise(raw: bytes) -> bytes:
    """Each run of the six white-space bytes becomes one space."""
    words = raw.split()
    if not words:
        return b" " if raw else b""
    return (b" " if raw[0] in _SPACE else b"") + b" ".join(words) + (b" " if raw[-1] in _SPACE else b"")


def _hash(block: bytes) -> int:
    return xxhash.xxh3_64_intdigest(block) - (1 << 63)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, carry: bool = False) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``; with
    ``carry``, the input row too, as the struct ``row``."""
    rows = _collapsed(docs, id_col, text_col, block_bytes, carry)
    own = F.struct(F.col("id").isNull(), "id", "rid")
    members = rows.groupBy("rep").agg(F.min(own).alias("least"), F.count("*").alias("n"))
    named = identities(rows)
    groups = named.join(members, "rep").groupBy("level", "name").agg(F.min("least").alias("least"), F.sum("n").alias("group_size"))
    groups = named.join(groups, ["level", "name"]).select("rep", "least", "group_size")
    return rows.join(groups, "rep").select(
        F.col("id").alias(id_col),
        F.col("least.id").alias("keep_id"),
        "group_size",
        (F.col("rid") == F.col("least.rid")).alias("kept"),
        "text_sha256",
        *(["row"] if carry else []),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows that stay, with the input's columns."""
    return rows_of(exact_groups(docs, id_col, text_col, block_bytes, carry=True).where("kept"), docs)


def _collapsed(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, carry: bool) -> DataFrame:
    """Rows with a number ``rid``, the number ``rep`` of the batch's first equal row, and, in that
    row only, the blocks of the normalised text with their hashes."""

    def run(batches):
        rid = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text"):
            first: dict[bytes, tuple[int, str]] = {}
            reps, shas, blocks, hashes = [], [], [], []
            for i, raw in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                text = normalise(raw)
                found = first.get(text)
                if found is None:
                    found = first[text] = (rid + i, hashlib.sha256(text).hexdigest())
                    blocks.append([text[k : k + block_bytes] for k in range(0, len(text), block_bytes)] or [b""])
                    hashes.append([_hash(b) for b in blocks[-1]])
                else:
                    blocks.append(None)
                    hashes.append(None)
                reps.append(found[0])
                shas.append(found[1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    *([batch.column("row")] if carry else []),
                    pa.array(range(rid, rid + len(reps)), pa.int64()),
                    pa.array(reps, pa.int64()),
                    pa.array(shas, pa.string()),
                    pa.array(blocks, pa.list_(pa.binary())),
                    pa.array(hashes, pa.list_(pa.int64())),
                ],
                names=["id", *(["row"] if carry else []), "rid", "rep", "text_sha256", "blocks", "hashes"],
            )
            rid += len(reps)

    rows = docs.select(
        field(id_col).alias("id"),
        unicode_text(text_col).alias("text"),
        *([whole_row(docs)] if carry else []),
    )
    kept = T.StructType([f for f in rows.schema.fields if f.name != "text"])
    for name, kind in (("rid", T.LongType()), ("rep", T.LongType()), ("text_sha256", T.StringType()), ("blocks", T.ArrayType(T.BinaryType())), ("hashes", T.ArrayType(T.LongType()))):
        kept = kept.add(name, kind)
    return staged(rows.mapInArrow(run, kept), "exact-dedup")


def identities(rows: DataFrame) -> DataFrame:
    """(rep, level, name) for the rows that have blocks: the one name that a text ends with."""
    texts = rows.where(F.col("blocks").isNotNull())
    width = F.size("hashes").alias("width")
    blocks = texts.select("rep", width, F.posexplode(F.arrays_zip("hashes", "blocks")).alias("place", "b")).select("rep", "width", "place", F.col("b.hashes").alias("hash"), F.col("b.blocks").alias("block"))
    places = texts.select("rep", width, F.posexplode("hashes").alias("place", "hash"))
    most = rows.agg(F.max(F.size("hashes"))).first()[0] or 0
    named = cut(_named(places, blocks, ["block"]))
    found, level = [], 0
    while True:
        found.append(named.where("width = 1").select("rep", F.lit(level).alias("level"), "name"))
        if most <= 1:
            break
        even = F.col("place") % 2 == 0
        pairs = (
            named.where("width > 1")
            .groupBy("rep", F.floor(F.col("place") / 2).cast("int").alias("half"))
            .agg(
                F.max(F.when(even, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right"),
                F.floor((F.first("width") + 1) / 2).cast("int").alias("width"),
            )
        )
        pairs = cut(pairs.select("rep", "width", F.col("half").alias("place"), F.xxhash64("left", "right").alias("hash"), "left", "right"))
        named = cut(_named(pairs, pairs, ["left", "right"]))
        most, level = (most + 1) // 2, level + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _named(places: DataFrame, keyed: DataFrame, key: list[str]) -> DataFrame:
    """(rep, width, place, name): equal keys get equal integers, unequal keys unequal ones.

    A name is the rank of the distinct (hash, key) within the hash's bucket, so a key that is
    everywhere is ranked once. A hash that one key alone has stands for it from then on; the keys of
    other hashes, if there are any, are ranked and joined by themselves. ``keyed`` is ``places`` with
    the keys."""
    distinct = keyed.select("hash", *key).distinct()
    counted = distinct.groupBy("hash").agg(F.count("*").alias("keys")).withColumn("bucket", F.pmod("hash", F.lit(BUCKETS)))
    before = F.sum("keys").over(Window.partitionBy("bucket").orderBy("hash").rowsBetween(Window.unboundedPreceding, -1))
    ranked = cut(counted.select("hash", "keys", (F.col("bucket") * (1 << 40) + F.coalesce(before, F.lit(0))).alias("name")))
    out = places.select("rep", "width", "place", "hash").join(ranked.where("keys = 1"), "hash").select("rep", "width", "place", "name")
    clashing = ranked.where("keys > 1")
    if clashing.isEmpty():
        return out
    within = F.row_number().over(Window.partitionBy("hash").orderBy(*key)) - 1
    names = distinct.join(clashing, "hash").select("hash", *key, (F.col("name") + within).alias("name"))
    return out.unionByName(keyed.select("rep", "width", "place", "hash", *key).join(names, ["hash", *key]).select("rep", "width", "place", "name"))
