"""Encoding and decoding with a sentencepiece model through a table of distinct chunks.

White space is a marker inside such a vocabulary's pieces, and where no piece has a marker after
another character, no piece crosses from one marked word into the next: the segmentation of a text
is that of its marked words, one after the other. So each distinct marked word (its run of markers
and the characters up to the next one) is segmented once per task, its ids go into one flat array,
and a document's ids are gathered from there by the position of its words. ``Chunks`` checks the
model for what this needs and refuses others.

A table that has more than ``TABLE_CHUNKS`` words or ``TABLE_CHARS`` characters starts anew at the
next slice of texts, which bounds the memory and changes no result. Nothing is shuffled, so a lost
executor costs its own tasks only.

Null text counts as empty: no ids, and an empty decoded text. A null array of ids decodes to an empty
text; ids outside the vocabulary fail the task. Null or repeated ids of rows, repeated rows and ties
go through row for row. Only the named columns are read, so other columns may have any name; an
empty table gives an empty table. A long text takes memory in proportion to its length.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from tidemark.llm.common import field, slices, unicode_text

MARKER = "▁"
TABLE_CHUNKS = 400_000
TABLE_CHARS = 32_000_000
#: Ids that a batch hands to the decoder at once.
DECODE_IDS = 1 << 20
_AFTER_SPACE = re.compile(" ( *[^ ]*)")


def marked_words(text: str) -> list[str]:
    """The marked words of a text, each without its first marker; ``' '.join`` gives the text back."""
    if not text:
        return []
    text = text.replace(MARKER, " ")
    if text[0] != " " and "  " not in text:
        return text.split(" ")
    return _AFTER_SPACE.findall(" " + text)


class Codes(dict):
    """Distinct marked words by number; new ones wait in ``new`` for their ids."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


class Chunks:
    """A model, and the ids of the distinct marked words seen so far."""

    def __init__(self, path: str) -> None:
        self.library = SentencePieceProcessor(model_file=path)
        model = sentencepiece_model_pb2.ModelProto.FromString(self.library.serialized_model_proto())
        how, kinds = model.normalizer_spec, model.SentencePiece
        if how.precompiled_charsmap or how.remove_extra_whitespaces or not how.add_dummy_prefix or not how.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that leave texts as they are and mark white space in front of words are supported")
        if any(MARKER in p.piece.lstrip(MARKER) for p in model.pieces) or any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("a piece of this model crosses white-space markers")
        self.marker = self.library.piece_to_id(MARKER)
        if self.marker == self.library.unk_id():
            raise ValueError("the white-space marker is not a piece of this model")
        self._reset()

    def _reset(self) -> None:
        self.codes, self.chars = Codes(), 0
        self.start, self.flat = array("q", [0]), array("i")

    def _segment_new(self) -> None:
        """The library puts the first marker in front of a word itself, but of an empty one makes nothing."""
        new, self.codes.new = self.codes.new, []
        for word, ids in zip(new, self.library.encode(new, num_threads=1), strict=True):
            self.flat.extend(ids if word else [self.marker])
            self.start.append(len(self.flat))
            self.chars += len(word)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.codes) > TABLE_CHUNKS or self.chars > TABLE_CHARS:
            self._reset()
        code_of = self.codes.__getitem__
        codes = [np.fromiter(map(code_of, words), np.int64, len(words)) for words in map(marked_words, texts)]
        self._segment_new()
        start, flat = np.array(self.start, copy=False), np.array(self.flat, copy=False)
        return [self._gathered(c, start, flat) for c in codes]

    @staticmethod
    def _gathered(codes: np.ndarray, start: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """The ids of the words in their places."""
        if not len(codes):
            return np.empty(0, np.int32)
        first = start[codes]
        size = start[codes + 1] - first
        ends = size.cumsum()
        at = np.repeat(first - (ends - size), size)
        at += np.arange(ends[-1])
        return flat[at]


@lru_cache(maxsize=2)
def chunks(path: str) -> Chunks:
    """One table per worker process and model."""
    return Chunks(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """One row per document: id, and the ids of its whole text without begin and end ids."""

    def run(batches):
        table = chunks(path)
        for batch in slices(batches, "text"):
            found = table.encode(batch.column("text").to_pylist())
            offsets = np.zeros(len(found) + 1, np.int32)
            np.cumsum([len(x) for x in found], out=offsets[1:])
            values = np.concatenate([*found, np.empty(0, np.int32)])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[id_col, ids_col])

    kind = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(ids_col, T.ArrayType(T.IntegerType()))])
    return docs.select(field(id_col).alias("id"), unicode_text(text_col).alias("text")).mapInArrow(run, kind)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """The rows with the text that the library makes of their ids."""

    def run(batches):
        library = chunks(path).library
        for batch in batches:
            ids = batch.column(len(names) - 1)
            sizes = pc.fill_null(pc.list_value_length(ids), 0).to_pylist()
            begin = 0
            while begin < len(sizes):
                end, held = begin + 1, sizes[begin]
                while end < len(sizes) and held + sizes[end] <= DECODE_IDS:
                    held, end = held + sizes[end], end + 1
                texts = library.decode([x or [] for x in ids.slice(begin, end - begin).to_pylist()], num_threads=1)
                kept = [c.slice(begin, end - begin) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string())], names=names)
                begin = end

    kept = T.StructType([f for f in encoded.schema.fields if f.name != text_col]).add(text_col, T.StringType())
    names = kept.names
    plain = [field(n).alias(f"c{i}") for i, n in enumerate(names[:-1])]  # a name with a dot or backtick can't go into mapInArrow
    return encoded.select(*plain, field(ids_col).alias("ids")).mapInArrow(run, kept)


def ids_text(ids_col: str = "ids"):
    """The ids as decimals, joined by commas."""
    return F.concat_ws(",", field(ids_col).cast("array<string>"))
