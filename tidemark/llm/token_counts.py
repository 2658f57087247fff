"""Token counts at every prefix of a text, and the budget questions they answer.

``prefix_counts`` gives one row per input row: the id column, ``n_bytes`` (UTF-8) and
``prefix_counts``, where element ``i`` (from 1) is the exact number of tokens of the first ``i``
characters. The last element is the count of the whole text. Once stored, truncation and budget
questions are answered from the array by ``tokens_before``, ``longest_prefix`` and ``n_tokens``;
nothing is encoded again.

Null or empty texts have an empty array and count 0. Null or repeated ids, repeated rows and ties
are passed through, row for row. Only the id and text columns are read, so other columns may have
any name. An empty table gives an empty table. Very long texts take memory in proportion to the
text (one integer per character), and long pieces are processed in linear time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bpe
from tidemark.llm.common import field, slices, unicode_text


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``n_bytes``, ``prefix_counts``. ``path``: the vocabulary file."""

    def run(batches):
        table = bpe.PrefixTable(bpe.vocabulary(path))
        for batch in slices(batches, "text", 4 << 20):
            counts = [table.counts(text) for text in batch.column("text").to_pylist()]
            offsets = np.zeros(len(counts) + 1, np.int32)
            np.cumsum([len(c) for c in counts], out=offsets[1:])
            values = np.concatenate([*counts, np.empty(0, np.int32)]).astype(np.int32, copy=False)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pc.binary_length(batch.column("text")).cast(pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                ],
                names=["id", "n_bytes", "prefix_counts"],
            )

    rows = docs.select(field(id_col).alias("id"), unicode_text(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"]]).add("n_bytes", "long").add("prefix_counts", T.ArrayType(T.IntegerType()))
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def n_tokens(counts: Column) -> Column:
    """Tokens of the whole text."""
    return F.when(F.size(counts) == 0, F.lit(0)).otherwise(F.element_at(counts, -1)).cast("long")


def tokens_before(counts: Column, n_chars: Column) -> Column:
    """Tokens of the first ``n_chars`` characters."""
    last = F.least(n_chars.cast("int"), F.size(counts))
    return F.when(last < 1, F.lit(0)).otherwise(F.get(counts, last - 1)).cast("long")


def longest_prefix(counts: Column, budget: Column | int) -> Column:
    """Characters of the longest prefix with at most ``budget`` tokens (0: none). Counts may fall
    again when a longer token forms, so the last fitting prefix is taken, not the first excess."""
    limit = F.lit(budget)
    fits = F.filter(F.transform(counts, lambda n, i: F.when(n <= limit, i + 1)), lambda i: i.isNotNull())
    return F.when(n_tokens(counts) <= limit, F.size(counts)).otherwise(F.coalesce(F.array_max(fits), F.lit(0))).cast("long")
