"""The conversation trie against a plain trie in memory."""

import hashlib
import random
import zlib

import pytest

from tidemark.llm import prefix_trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_bytes", "ends_sha256"]


def rebuilt(rows):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    return {c: tuple(own.get(c - c % 5, [])[: zlib.crc32(str(c).encode()) % 9] + own[c][zlib.crc32(str(c).encode()) % 9 :]) for c in own}


def plain_trie(seqs):
    members, ends, kids = {}, {}, {}
    for c, s in seqs.items():
        ends.setdefault(s, []).append(c)
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for s in members:
        if s:
            kids.setdefault(s[:-1], []).append(s)
    below = {}
    for s in sorted(members, key=len, reverse=True):
        own = (len(members[s]) - 1) * len(s[-1][1].encode()) if s else 0
        below[s] = (sum(below[k][0] for k in kids.get(s, [])) or 1, own + sum(below[k][1] for k in kids.get(s, [])))
    told = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(((min(m), len(s), min(members[s[:-1]]) if s else None, len(m), len(kids.get(s, [])), *below[s], told(ends.get(s, []))) for s, m in members.items()), key=str)


def found(spark, rows, tasks=4):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, id int, `seq.` string").repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(tasks))
    try:
        return sorted((tuple(r[n] for n in NAMES) for r in prefix_trie.nodes(prefix_trie.spliced(prefix_trie.turns(table))).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def conversations(seed, n):
    """Short alphabets, so that prefixes, copies and prefixes that end are common; a hot first turn and
    conversation; some null numbers, roles and texts."""
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        copy = rng.random() < 0.3
        for t in range(rng.choice([1, 2, 3, 3, 4, 12])):
            number = None if t == 0 and rng.random() < 0.1 else t
            rows.append((c, number, "u" if copy else rng.choice(["u", "a", None]), "hot" if copy else rng.choice(["x", "yé", "zz", None])))
    return rows


@pytest.mark.parametrize(("tasks", "fan"), [(1, 64), (5, 64), (9, 2)])
def test_against_a_plain_trie(spark, monkeypatch, tasks, fan):
    monkeypatch.setattr(prefix_trie, "FAN", fan)
    rows = conversations(tasks, 150)
    assert found(spark, rows, tasks) == plain_trie(rebuilt(rows))


def test_long_and_turnless_conversations(spark):
    # 3 has one turn, of which its number may leave none when its group's first is absent; 10 is very long
    rows = [(3, 0, "u", "a"), (4, 0, "u", "a" * 50_000)] + [(10, t, "u", "é") for t in range(3000)] + [(11, t, "u", "é") for t in range(2999)] + [(None, 0, "u", "lost")]
    assert found(spark, rows) == plain_trie(rebuilt(rows))


def test_equal_conversations_in_many_runs(spark):
    rows = [(c * 700, 0, "u", "same") for c in range(50)]
    assert found(spark, rows) == plain_trie(rebuilt(rows))


def test_tied_turns_have_one_order_whatever_the_rows(spark):
    rows = [(1, 0, "u", "b"), (1, 0, "u", "a"), (1, 0, "u", "a"), (1, None, None, None), (6, 0, "u", "a"), (6, 0, "u", "b"), (6, 0, "u", "a"), (6, None, "", "")]
    both = found(spark, rows)
    assert both == found(spark, rows[::-1]) and sum(r[3] for r in both if r[1] == 0) == 2


def test_no_conversations(spark):
    assert found(spark, [(None, 0, "u", "x")]) == []
