import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import exact_dedup, near_dedup
from tidemark.llm.components import components


def space(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(120):
        rows.append((i, " ".join(rng.choices(words, k=rng.choice([1, 3, 5, 40, 120])))))
    base = [rng.choices(words, k=60) for _ in range(6)]
    for i in range(120, 260):
        own = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(60)] = rng.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "a  b\n"), (304, "a b "), (305, "a b"), (306, "x" * 50_000), (307, "x" * 49_999 + "y"), (308, "x" * 50_000)]
    rows += [(None, "a b"), (305, "a b"), (None, None)]
    return spark.createDataFrame([(a, b, "clash", 1) for a, b in rows], "doc_id long, text string, `keep id.` string, rid int").repartition(3)


def test_exact_groups(docs):
    rows = docs.collect()
    groups = defaultdict(list)
    for r in rows:
        groups[space(r.text)].append(r.doc_id)
    found = exact_dedup.exact_groups(docs, block_bytes=16).collect()
    assert len(found) == len(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in groups.items()}
    kept = Counter()
    for r in found:
        own = by_sha[r.text_sha256]
        known = [x for x in own if x is not None]
        assert r.group_size == len(own)
        assert r.keep_id == (min(known) if known else None)
        if r.kept:
            kept[r.text_sha256] += 1
            assert r.doc_id == r.keep_id
    assert kept == Counter(by_sha.keys())


def test_drop_copies_keeps_columns(docs):
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    assert left.count() == len({space(r.text) for r in docs.collect()})
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_clashing_hashes_and_shared_headers(docs, spark, monkeypatch):
    """With a hash of four values nearly all blocks clash: names come from the keys themselves. Texts
    with one header, and texts that differ in their last block only, stay apart."""
    texts = ["h" * 64 + f"{i % 7}" for i in range(60)] + ["h" * 64, "h" * 63] + [f"{i}" for i in range(20)]
    own = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    monkeypatch.setattr(exact_dedup, "_hash", lambda block: len(block) % 4)
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda a, b: (exact_dedup.F.col(a) + exact_dedup.F.col(b)) % 3)
    for frame, texts_ in ((own, texts), (docs, [r.text for r in docs.collect()])):
        found = {r.text_sha256: r.group_size for r in exact_dedup.exact_groups(frame, block_bytes=16).collect()}
        assert found == {hashlib.sha256(k.encode()).hexdigest(): n for k, n in Counter(map(space, texts_)).items()}


def shingles(text, size):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_components(rows, size):
    sets = {i: shingles(r.text, size) for i, r in enumerate(rows)}
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    members = defaultdict(list)
    for i in sets:
        members[root(i)].append(rows[i].doc_id)
    least = {k: min([x for x in v if x is not None], default=None) for k, v in members.items()}
    return Counter((r.doc_id, len(sets[i]), least[root(i)]) for i, r in enumerate(rows)), len(members)


@pytest.mark.parametrize("size", [4, 5])
def test_near_groups_match_brute_force(docs, size):
    rows = docs.collect()
    expected, groups = brute_components(rows, size)
    found = near_dedup.near_groups(docs, shingle=size).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == expected
    assert sum(r.survivor for r in found) == groups
    left = near_dedup.drop_near_copies(docs, shingle=size)
    assert left.columns == docs.columns and left.count() == groups
    assert near_dedup.near_groups(docs.limit(0)).count() == 0


@pytest.mark.parametrize("blocks", [64, 0])
def test_near_groups_oversize_nodes(spark, docs, monkeypatch, blocks):
    """Small limits send every group through chunks, pivots, branching, and blocks or rare shingles."""
    for name, value in (("NODE", 24), ("GROUP", 16), ("PIVOTS", 4), ("LEVELS", 1), ("FEW", 1), ("BLOCKS", blocks)):
        monkeypatch.setattr(near_dedup, name, value)
    rows = docs.collect()
    expected, _ = brute_components(rows, 4)
    found = near_dedup.near_groups(docs, shingle=4).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in found) == expected


def test_trees_over_one_boilerplate_group_are_independent(spark):
    """Six trees' nodes with the same 1,200 members: a pair that one splits must meet in another."""
    rng = np.random.default_rng(11)
    n, width = 600, near_dedup.SKETCH
    common = rng.integers(0, 256, width)
    own = lambda: np.where(rng.random((n, width)) < 0.45, common, rng.integers(0, 256, (n, width)))
    first = own()
    second = np.where(rng.random((n, width)) < 0.8, first, own())
    same = (first == second).sum(axis=1)
    sketches = [bytes(row.astype(np.uint8).tolist()) for pair in zip(first, second, strict=True) for row in pair]
    nodes = [(key, 0, i, 400, i, sketch) for key in (-5, 12, 1 << 60, 77, 901, 3) for i, sketch in enumerate(sketches)]
    rows = spark.createDataFrame(nodes, "key long, sub long, cls long, n long, group long, sketch binary")
    group = {r.node: r.component for r in components(near_dedup._alike(rows, 80)).collect()}
    lost = [i for i in range(n) if same[i] >= 48 and group.get(2 * i, -1) != group.get(2 * i + 1, -2)]
    assert lost == []


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 3), (9, 8), (8, 7), (7, 6), (6, 5), (20, 21), (21, 20)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {n: c for n, c in found.items()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 5, 8: 5, 9: 5, 20: 20, 21: 20}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
