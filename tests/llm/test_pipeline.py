"""The pipeline's stages and run() against brute force, and the SQL oracles against DuckDB."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tidemark.llm import queries

DIR = "/root/testdata/sf0.01"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return text.translate({c: c + 32 for c in range(65, 91)})


def windows(text):
    words = WORDS.findall(lower(text))
    size = min(10, len(words))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if size else set()


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with exact and near copies, benchmark passages, odd texts, nulls and repeated rows; a
    column whose name clashes with the stages' own."""
    rng = random.Random(9)
    words = [f"word{i}" for i in range(500)]
    leak = " ".join(rng.choices(words, k=30))
    clean = [" ".join(rng.choices(words, k=rng.choice([6, 40, 300]))) for _ in range(40)]
    texts = [*clean, clean[0], f"{clean[1]} \n", clean[2].replace(" ", "  "), "123 !?", None, "", " ", "x" * 9000, f"so {leak} it is"]
    near = clean[3:12]
    for text in near:
        own = text.split()
        if len(own) > 100:
            own[7] = "changed"
            texts.append(" ".join(own))
    rows = [(i, t, "en" if i % 3 else None, "s", i) for i, t in enumerate(texts)] + [(0, texts[0], "en", "s", 0), (None, texts[5], None, None, 1)]
    path = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, `keep.id` int").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak), (2, leak), (None, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, [r[1] for r in rows], leak


def test_stages_against_brute_force(spark, tables):
    path, texts, leak = tables
    docs, left = spark.read.parquet(f"{path}/documents.parquet"), Counter(texts)
    columns = docs.columns

    def step(name):
        nonlocal docs
        docs = spark.createDataFrame(dict(corpus_pipeline.STAGES)[name](spark, docs, path).collect(), docs.schema)
        assert docs.columns == columns
        return Counter(r.text for r in docs.collect())

    assert step("language_id") == Counter(t for t in left.elements() if any(map(str.isalpha, t or "")))
    kept = step("exact_dedup")
    assert {re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in kept} == {re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in texts if any(map(str.isalpha, t or ""))}
    assert sum(kept.values()) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t) for t in kept})
    rows = list(kept)
    sets, up = [shingles(t) for t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    near = step("near_dedup")
    assert Counter(root(rows.index(t)) for t in near) == Counter({root(i): 1 for i in range(len(rows))}) and sum(near.values()) < len(rows)
    assert step("decontamination") == Counter({t: 1 for t in near if not windows(t) & windows(leak)})


def test_a_document_that_no_language_claims_goes(spark):
    """Three languages with the same words and one of their own each: a text of an own word stays, one
    of common words or of unknown letters, which all three explain alike, goes, letters or not."""
    own = {"a": "κ", "b": "λ", "c": "μ"}
    labelled = [(i, text, lang) for i in range(30) for lang, word in own.items() for text in ("water under winter", f"{word} {word}")]
    texts = {"κ": True, "λ water " * 500: True, "under μ": True, "water winter": False, "under " * 3000: False, "Ж": False, "κ λ μ": False, "12 3": False, "": False, None: False}
    asked = [(100 + k, text, None) for k, text in enumerate(texts)]
    docs = spark.createDataFrame(labelled + asked, "doc_id long, text string, lang string")
    kept = corpus_pipeline.keep_known_language(spark, docs, "")
    assert kept.columns == docs.columns
    assert [r.text for r in kept.where("doc_id >= 100").orderBy("doc_id").collect()] == [t for t, stays in texts.items() if stays]
    assert kept.where("doc_id < 100 and text like 'water%'").count() == 0 and kept.where("doc_id < 100").count() == 90


def test_run_packs_what_the_stages_keep(spark, tables):
    path, texts, leak = tables
    found = corpus_pipeline.run(spark, path).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc, by_sequence = defaultdict(int), defaultdict(list)
    for r in found:
        by_doc[r.doc_id] += r.length
        by_sequence[r.sequence_id].append((r.offset, r.length))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    for i, n in by_doc.items():
        assert n == len(library.encode(docs[i], add_special_tokens=False).ids) + 1
        assert any(map(str.isalpha, docs[i])) and not windows(docs[i]) & windows(leak)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len({re.sub(r"\s+", " ", docs[i]) for i in by_doc}) == len(by_doc)
    clean = [i for i, t in docs.items() if i is not None and i < 40]
    assert len([i for i in clean if i in by_doc]) >= 39  # the copies go, one of each group stays


def test_empty_tables(spark, tables, tmp_path):
    path, _, _ = tables
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    from tidemark import storage

    class Elsewhere:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(dict)

    with pytest.raises(ValueError):
        storage.shared_dir(type("Session", (), {"sparkContext": Elsewhere})())


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object)
    rows = [tuple(None if pd.isna(v) else bool(v) if isinstance(v, bool) else v for v in r) for r in df.itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    found, expected = queries.QUERIES[name](spark, DIR).toPandas(), duck.sql(queries.ORACLES[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert plain(found) == plain(expected) and len(found)


def test_recall_of_the_near_duplicate_search(spark):
    """Rows whose id is divisible by 100, against all rows, by brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    found = {r.doc_id: r.component_id for r in queries.near_dedup.near_groups(docs, shingle=4).select("doc_id", "component_id").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    split = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for i, t in texts.items()}
    sets = {i: {hash(tuple(w[k : k + 4])) for k in range(max(1, len(w) - 3))} for i, w in split.items() if w}
    asked = [i for i in sets if i % 100 == 0]
    links = [(i, j) for i in asked for j, other in sets.items() if i != j and min(len(sets[i]), len(other)) * 100 >= 80 * max(len(sets[i]), len(other)) and (both := len(sets[i] & other)) and 100 * both >= 80 * (len(sets[i]) + len(other) - both)]
    met = sum(found[i] == found[j] for i, j in links)
    print(f"recall {met / len(links):.4f} over {len(links)} links of {len(asked)} queries")
    assert len(links) >= 20 and met / len(links) >= 0.99
