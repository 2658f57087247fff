"""Encoding and decoding against the sentencepiece library."""

import random

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from tidemark.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
ODD = ["", " ", "  ", "a", " a", "a ", "  a  b ", "▁", "a▁b", "▁ a", "\n a\tb\r\n", "日本 ☃ \U0001f9ff", "<s> x </s><unk>", "\x00", "a\xa0b　c", "é é ﬁ", "x" * 40_000, "y " * 30_000, "<0x0A>", " "]


def test_words_give_the_text_back():
    for text in ODD:
        assert " ".join(pieces.marked_words(text)) == text.replace("▁", " ")


@pytest.mark.parametrize("limit", [1, 400_000])
def test_random_texts(monkeypatch, limit):
    monkeypatch.setattr(pieces, "TABLE_CHUNKS", limit)
    rng = random.Random(limit)
    letters = [" ", "  ", "▁", "a", "b", "the", "ing", "\n", "日", "é", "\U0001f9ff", "<s>", "1", ".", "\xa0"]
    table = pieces.Chunks(PATH)
    for _ in range(20):
        texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(100)]
        assert [x.tolist() for x in table.encode(texts)] == LIBRARY.encode(texts)


def test_encode_and_decode(spark, monkeypatch):
    monkeypatch.setattr(pieces, "DECODE_IDS", 50)
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, "null id", None), (50, None, None), (3, ODD[3], "again")]
    docs = spark.createDataFrame(rows, "`doc.``id` long, text string, ids string").repartition(3)
    found = pieces.decode(pieces.encode(docs, PATH, "doc.`id"), PATH).collect()
    expected = [(i, LIBRARY.encode(t or ""), LIBRARY.decode(LIBRARY.encode(t or ""))) for i, t, _ in rows]
    assert sorted((tuple(r) for r in found), key=str) == sorted(expected, key=str)


def test_decode_of_missing_ids_and_other_columns(spark):
    rows = spark.createDataFrame([(1, None, "a"), (2, [264, 287], "b"), (3, [], "c")], "k int, ids array<int>, decoded string")
    assert [(r.k, r.decoded) for r in pieces.decode(rows, PATH).orderBy("k").collect()] == [(1, ""), (2, LIBRARY.decode([264, 287])), (3, "")]
    assert pieces.decode(pieces.encode(spark.createDataFrame([], "doc_id long, text string"), PATH), PATH).count() == 0


def test_a_word_is_segmented_once():
    table, calls = pieces.Chunks(PATH), []
    encode = table.library.encode
    table.library = type("Counted", (), {"encode": staticmethod(lambda words, num_threads: calls.extend(words) or encode(words, num_threads=1))})
    for _ in range(3):
        table.encode(["the cat and the dog", "the dog"])
    assert sorted(calls) == ["and", "cat", "dog", "the"]
    assert np.concatenate(table.encode(["the dog"])).tolist() == LIBRARY.encode("the dog")
