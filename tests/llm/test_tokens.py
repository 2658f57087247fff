import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import bpe, packing, token_counts
from tidemark.llm.packing import make_plan

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
TEXTS = [
    "hello  world's 're we'll  \n\n  x<|endoftext|>y <|endof", "a'r'll", "  ", "\n\n\nab   ", "²³½ … “quoted”—日本語のテキスト éàü", "----------====",
    "<|endoftext|>", "x'<|endoftext|>'ll <|endoftext|>", "\x1c\x85 a　 b", "a\xa0 b don't 12345 _x_", "", "word " * 700, "x" * 5000,
]


def count(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", [t for t in TEXTS if len(t) < 200])
def test_every_prefix(text):
    table = bpe.PrefixTable(bpe.vocabulary(PATH))
    assert table.counts(text).tolist() == [count(text[: i + 1]) for i in range(len(text))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(99, None, None), (None, "null id", "y"), (3, TEXTS[3], "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, prefix_counts string")


def test_counts_and_budgets(docs):
    found = token_counts.prefix_counts(docs, PATH)
    c = F.col("prefix_counts")
    rows = found.select("doc_id", "n_bytes", token_counts.n_tokens(c).alias("n"), token_counts.tokens_before(c, F.lit(5)).alias("five"), token_counts.longest_prefix(c, 3).alias("fits")).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        text = {99: "", None: "null id"}.get(r.doc_id, TEXTS[r.doc_id] if r.doc_id is not None and r.doc_id < 99 else "")
        text = "null id" if r.doc_id is None else text
        assert (r.n_bytes, r.n, r.five) == (len(text.encode()), count(text), count(text[:5]))
        if len(text) < 200:
            assert r.fits == max([i for i in range(len(text) + 1) if count(text[:i]) <= 3])


def test_empty_tables(spark, docs):
    assert token_counts.prefix_counts(docs.limit(0), PATH).count() == 0
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_packing_round_trip(docs):
    import zlib

    import numpy as np

    rows = packing.pack(docs, PATH, capacity=64).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
    for i, text in enumerate(TEXTS):
        if i == 3:
            continue  # its id is repeated
        ids = [*LIBRARY.encode(text, add_special_tokens=False).ids, 0]
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        assert [p.length for p in pieces[1:]] == [64] * (len(pieces) - 1)
        at = 0
        for k, p in enumerate(pieces):
            assert (p.piece, p.start) == (k, at)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)


@pytest.mark.parametrize("histogram", [{}, {2048: 3}, {1: 5000}, {1025: 7, 1023: 7}, {700: 999, 650: 500, 300: 400, 40: 10_000}, {n: 3 for n in range(1, 2049)}])
def test_plan_is_whole_and_tight(histogram):
    placed, taken = {}, {}
    for length, lo, hi, first, per, offset in make_plan(histogram):
        placed[length] = placed.get(length, 0) + hi - lo
        for rank in range(lo, hi):
            taken.setdefault(first + (rank - lo) // per, []).append((offset + (rank - lo) % per * length, length))
    assert placed == histogram
    for rows in taken.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    least = -(-sum(n * c for n, c in histogram.items()) // 2048)
    assert len(taken) <= max(least * 1.12 + 2, 0) or 700 in histogram
