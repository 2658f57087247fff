"""Vector codes against plain integer k-means."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import vector_codes as vc


def plain_codes(rows, parts, entries, rounds):
    """rows: (id, vector, label) that take part, in order. {row: (code, error)}, label errors, codebooks."""
    x = np.floor(4096 * np.array([r[1] for r in rows], float)).astype(np.int64)
    x = x.reshape(len(x), parts, -1)
    books = x[:entries].swapaxes(0, 1).copy()
    for step in range(rounds + 1):
        apart = ((x[:, :, None] - books[None]) ** 2).sum(-1)
        code, error = apart.argmin(2), apart.min(2).sum(1)
        if step < rounds:
            new = books.copy()
            for p in range(parts):
                for e in range(books.shape[1]):
                    own = x[code[:, p] == e, p]
                    if len(own):
                        new[p, e] = own.sum(0) // len(own)
            books = new
    labels = {}
    for r, e in zip(rows, error.tolist(), strict=True):
        labels[r[2]] = labels.get(r[2], 0) + e
    return sorted(((r[0], "".join(f"{c:02x}" for c in k), e, labels[r[2]]) for r, k, e in zip(rows, code.tolist(), error.tolist(), strict=True)), key=str), hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def found(spark, rows, parts=4, entries=8, rounds=3):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, rid int, `code.` string").repartition(3)
    coded, books = vc.compress(table, parts, entries, rounds)
    out = vc.with_label_error(coded).select("vec_id", vc.code_text().alias("code"), "error", "label_error").collect()
    return sorted(map(tuple, out), key=str), books.sha256()


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_k_means(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(i), rng.normal(0, 0.3, 16).astype(np.float32).tolist(), int(rng.integers(4)) if i % 7 else None) for i in rng.permutation(700)]
    hot = rows[5][1]
    rows += [(1000 + i, hot, 2) for i in range(400)]
    assert found(spark, rows) == plain_codes(sorted(rows), 4, 8, 3)


def test_rows_that_take_no_part(spark):
    rng = np.random.default_rng(3)
    fine = [(i, rng.normal(0, 0.3, 16).astype(np.float32).tolist(), None) for i in range(5, 25)]
    nan, inf = float("nan"), float("inf")
    bad = [None, [], [nan] * 16, [0.1] * 15 + [inf], [0.1] * 15 + [None], [1e6] * 16, [0.5] * 8]
    # fewer rows than entries; ties of equal vectors; a repeated and a null id
    rows = [*fine[:5], (5, fine[0][1], 1), (None, fine[1][1], 1)]
    expected = plain_codes(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), 4, 16, 3)
    assert found(spark, rows + [(i, v, 1) for i, v in zip(range(100, 200), bad, strict=False)], entries=16) == expected


def test_empty_and_uneven(spark):
    assert found(spark, []) == ([], hashlib.sha256(b"").hexdigest())
    with pytest.raises(ValueError, match="equal parts"):
        found(spark, [(1, [0.5] * 6, 0)])


def test_shortlists_keep_every_winner():
    rng = np.random.default_rng(4)
    for _ in range(50):
        rows, entries = rng.integers(-50, 50, (60, 3)) // rng.integers(1, 9), rng.integers(-50, 50, (9, 3))
        short = vc.shortlists(rows.min(0)[None], rows.max(0)[None], entries)[0]
        everyone = np.arange(9)
        code, error = vc.nearest(rows, entries, everyone)
        assert set(code) <= set(np.flatnonzero(short))
        again, same = vc.nearest(rows, entries, np.flatnonzero(short))
        assert (code == again).all() and (error == same).all()


def test_hilbert_neighbours_are_near():
    side = np.array([(a, b) for a in range(16) for b in range(16)])
    place = vc.hilbert(side, np.array([0, 0]), np.array([15, 15]))
    walk = side[np.argsort(place)]
    assert len(set(place.tolist())) == 256
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()


def test_a_common_vector_is_dealt_out(spark):
    rows = spark.range(4000).select(F.col("id"), F.lit(0).alias("label"), F.array(*[F.lit(0.25)] * 8).alias("v"))
    made, _ = vc.train(vc.integers(rows, "id", "v", "label"), 4, 2, 1)
    assert made.agg(F.max("n")).first()[0] <= vc.BLOCK
    assert made.select(F.input_file_name().alias("f")).distinct().count() > 1
