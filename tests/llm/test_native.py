import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tidemark.llm import fixity, sharding


def test_sharding_law_and_location(spark):
    texts = ["a", None, "", "é", "a", "x" * 4000]
    docs = spark.createDataFrame([(i % 900, texts[i % 6], "s", 1) for i in range(1000)] + [(None, "n", "s", 1)], "doc_id long, text string, shard string, slot int")
    rows = sharding.shard(docs).collect()
    n = len(rows)
    assert n == 1001 and sorted(r.row_number for r in rows) == list(range(n))
    for r in rows:
        assert (r.shard, r.slot) == sharding.locate(r.row_number, n)
    for k in range(8):
        slots = sorted(r.slot for r in rows if r.shard == k)
        assert slots == list(range(len(slots))) and abs(len(slots) - n / 8) < 1
    crc = {r.doc_id: r.text_crc32 for r in rows}
    assert crc[None] == zlib.crc32(b"n")
    again = {(r.row_number, r.shard, r.slot) for r in sharding.shard(docs.repartition(7)).collect()}
    assert again == {(r.row_number, r.shard, r.slot) for r in rows}
    assert sharding.shard(docs.limit(0)).count() == 0


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 7, 50, 1023):
        assert len({sharding.locate(i, n) for i in range(n)}) == n


def archive(spark, rows):
    """(file, id, body) rows as pages; a column clashes with the manifest's."""
    return spark.createDataFrame([(f, i, "http://x" if i % 7 else None, b, 1) for f, i, b in rows], "f string, `page.id` long, url string, html string, digest int")


def audited(spark, left, right):
    both = [fixity.manifest(archive(spark, rows), F.col("f"), "page.id") for rows in (left, right)]
    return {(r["file"], r["page.id"], r.damage) for r in fixity.audit(*both, "page.id").where("damage <> 'moved'").collect()}


@pytest.fixture(scope="module")
def rows():
    return [(f"a{i // 700}", i, "b" * (i % 40) if i % 11 else None) for i in range(1500)]


def test_fixity_finds_altered_lost_and_added_records(spark, rows):
    changed = [(f, i, "!" * (i % 40) if i % 601 == 5 else b) for f, i, b in rows]
    assert audited(spark, rows, changed) == {("a0", 5, "altered"), ("a0", 606, "altered"), ("a1", 1207, "altered")}
    fewer = [r for r in rows if r[1] not in (0, 699, 900) and r[0] != "a2"]
    gone = {("a0", 0), ("a0", 699), ("a1", 900), *((f, i) for f, i, _ in rows if f == "a2")}
    assert audited(spark, rows, fewer) == {(*x, "missing") for x in gone}
    assert audited(spark, fewer, rows) == {(*x, "extra") for x in gone}
    assert audited(spark, rows, rows[::-1]) == set()
    assert audited(spark, rows, []) == {(f, i, "missing") for f, i, _ in rows}
    assert audited(spark, [], []) == set()


def test_fixity_moves_and_neighbours(spark):
    """A lost record moves those behind it, in its own file only; [x, lost] isn't [lost, x]."""
    left = [("a", 1, "x"), ("a", 2, "x"), ("a", 3, "y"), ("b", 4, "x"), (None, 5, None), (None, 5, None)]
    both = [fixity.manifest(archive(spark, r), F.col("f"), "page.id") for r in (left, left[1:])]
    found = {(r["page.id"], r.damage) for r in fixity.audit(*both, "page.id").collect()}
    assert found == {(1, "missing"), (2, "moved"), (3, "moved")}
    assert audited(spark, [("a", 1, "x"), ("a", 2, "z")], [("a", 2, "z"), ("a", 3, "x")]) == {("a", 1, "missing"), ("a", 3, "extra")}
    assert audited(spark, left, left[:-1]) == {("\0null", 5, "missing")}
    leaves = fixity.manifest(archive(spark, left), F.col("f"), "page.id")
    assert [r.damage for r in fixity.audit(leaves, leaves.where("nth <> 0 or file <> 'a'"), "page.id").collect()] == ["missing"]
    swapped = leaves.withColumn("nth", F.when(F.col("file") == "a", 2 - F.col("nth")).otherwise(F.col("nth")))
    assert {r.damage for r in fixity.audit(leaves, swapped, "page.id").collect()} == {"moved"}


def test_offsets_and_root(spark, monkeypatch):
    monkeypatch.setattr(fixity, "SEGMENT", 7)
    pages = spark.createDataFrame([(i, "u", "v" * i) for i in range(40)], "page_id long, url string, html string")
    manifest = fixity.manifest(pages)
    listed = manifest.orderBy("nth").collect()
    assert listed[0].start == 0 and all(a.end == b.start for a, b in zip(listed, listed[1:], strict=False))
    level = [hashlib.sha256(f"{r.nth}:{r.start}:{r.end}:{r.digest}".encode()).hexdigest() for r in listed]
    while len(level) > 1:
        level = [hashlib.sha256("\n".join(f"{k + j}:{h}" for j, h in enumerate(level[k : k + 16])).encode()).hexdigest() for k in range(0, len(level), 16)]
    heights = fixity.shape(manifest, manifest)
    assert heights == (2, 0) and fixity.tree(manifest, heights)[2].first().hash == level[0]
