"""The operators of this subpackage over whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, exact_dedup, fixity, language_id, license_scan, near_dedup, packing, pieces, prefix_trie, secret_scan, sharding, token_counts, vector_codes
from tidemark.llm import oracles
from tidemark.llm.common import table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 1024


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.prefix_counts(table(spark, sf_dir, "documents"), BYTE_BPE)
    n = token_counts.n_tokens(F.col("prefix_counts"))
    fits = token_counts.longest_prefix(F.col("prefix_counts"), TOKEN_LIMIT)
    return counts.select("doc_id", "n_bytes", n.alias("n_tokens"), (n > TOKEN_LIMIT).alias("over_limit"), fits.alias("chars_within_limit"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup.near_groups(table(spark, sf_dir, "documents"), shingle=4)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive against a replica with damage by id: bodies rotated by a character, records lost
    (those behind move up in their file) and records that the archive never had."""
    pages = table(spark, sf_dir, "pages")
    body, hit = F.coalesce("html", F.lit("")), lambda n, k: F.pmod(F.col("page_id"), F.lit(n)) == k
    rotated = F.concat(F.substr(body, F.lit(2)), F.substr(body, F.lit(1), F.lit(1)))
    file = F.floor(F.col("page_id") / fixity.FILE_RECORDS)
    left = fixity.manifest(pages, file)
    held = pages.where(~F.coalesce(hit(4999, 31), F.lit(False))).select("page_id", file.alias("file"), "url", F.when(hit(97, 5), rotated).otherwise(body).alias("html"))
    added = pages.where(hit(97, 59)).select((F.col("page_id") + 1_000_000_000_000).alias("page_id"), file.alias("file"), "url", body.alias("html"))
    return fixity.audit(left, fixity.manifest(held.unionByName(added), F.col("file")))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.where(~language_id.held_out()), PIECES)
    return language_id.predict(docs, model, PIECES).withColumn("held_out", language_id.held_out())


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.recognise(table(spark, sf_dir, "documents"), rules=[*license_scan.RULES, *license_scan.NOTICES]))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(table(spark, sf_dir, "documents")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = prefix_trie.spliced(prefix_trie.turns(table(spark, sf_dir, "conversations")))
    return prefix_trie.nodes(rebuilt).withColumnRenamed("saved_bytes", "saved_tokens")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    rows = vector_codes.with_label_error(coded)
    return rows.select("vec_id", vector_codes.code_text().alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pieces.decode(pieces.encode(table(spark, sf_dir, "documents"), PIECES), PIECES)
    n = F.size("ids").cast("long").alias("n_tokens")
    return rows.select("doc_id", n, F.sha2(pieces.ids_text(), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_minhash_near_dedup, op3_warc_fixity, op4_exact_dedup, op5_sharding,
        op6_language_id, op7_license_scan, op8_secret_scan, op9_packing, op10_decontamination,
        op11_conversation_trie, op12_vector_codes, op13_sentencepiece,
    )
}
ORACLES = oracles.SQL
