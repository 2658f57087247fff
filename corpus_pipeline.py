"""From raw documents to packed sequences: language, exact copies, near copies, benchmark, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read again as the next stage's docs. All but the last return the columns of ``documents``.

Null texts have no letters and go in the first stage. Of equal or near texts the smallest id stays, a
null id only if the group has no other; repeated rows are copies of one another. Other columns are
carried whatever their names or values. Empty tables give an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, exact_dedup, language_id, near_dedup, packing
from tidemark.llm.common import remove, rows_of, shared_dir, table
from tidemark.llm.queries import BYTE_BPE, PIECES

#: Posterior of the predicted language from which a document stays: an even chance.
LEAST_SCORE = 0.5


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of which one language is at least as likely as all others together: the score of
    the prediction, its posterior, is ``LEAST_SCORE`` or more. Texts without letters have score 0. With
    a single language every letter is explained; without a labelled row no language is learned, and
    only the letters are looked at."""
    model = language_id.learn(docs, PIECES)
    if not model.languages:
        return docs.where(language_id.has_letter())
    found = language_id.predict(docs, model, PIECES, carry=True)
    return rows_of(found.where(F.col("score") >= LEAST_SCORE), docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose texts differ in white space only."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; five-word shingles, similarity 0.8."""
    return near_dedup.drop_near_copies(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold ten words in a row, or all words, of a benchmark item."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2,048 tokens; none is dropped."""
    return packing.pack(docs, BYTE_BPE)


STAGES = [
    ("language_id", keep_known_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("packing", pack_sequences),
]

#: Tokenisation and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces. A stage's table goes once the next is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark)}/tidemark-pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        made = stage(spark, docs, sf_dir)
        made.write.option("compression", "zstd").parquet(f"{base}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{base}/{name}")
        if before:
            remove(spark, f"{base}/{before}")
        before = name
    return docs
