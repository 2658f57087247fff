"""Ids and texts whose column names hold dots and backticks, beside columns named as the operators' own."""

import pytest

from tidemark.llm import decontaminate, exact_dedup, fixity, language_id, license_scan, near_dedup, packing, pieces, secret_scan, sharding, token_counts
from tidemark.llm.queries import BYTE_BPE, PIECES

TEXTS = ["one two three four five six", "one two three four five six", None, "", "Licensed under the MIT license."]


def audit(docs, i, t):
    made = fixity.manifest(docs, id_col=i, url_col="url", body_col=t)
    return fixity.audit(made, fixity.manifest(docs.where("url <> '1'"), id_col=i, url_col="url", body_col=t), i)


def scored(docs, i, t):
    return language_id.predict(docs, language_id.learn(docs, PIECES, i, t, "lang"), PIECES, i, t)


def leaks(docs, i, t):
    return decontaminate.digest(decontaminate.find(docs, docs, i, t, i, t), i)


OPERATORS = {
    "op1": lambda docs, i, t: token_counts.prefix_counts(docs, BYTE_BPE, i, t),
    "op2": near_dedup.near_groups,
    "op3": audit,
    "op4": exact_dedup.exact_groups,
    "op5": lambda docs, i, t: sharding.shard(docs, id_col=i, text_col=t),
    "op6": scored,
    "op7": lambda docs, i, t: license_scan.digest(license_scan.recognise(docs, id_col=i, text_col=t), i),
    "op8": lambda docs, i, t: secret_scan.digest(secret_scan.scan(docs, i, t), i),
    "op9": lambda docs, i, t: packing.pack(docs, BYTE_BPE, id_col=i, text_col=t),
    "op10": leaks,
    "op13": lambda docs, i, t: pieces.encode(docs, PIECES, i, t),
}


@pytest.mark.parametrize("name", OPERATORS)
@pytest.mark.parametrize(("id_col", "text_col"), [("doc.id", "a.text"), ("do`c", "te`xt."), ("text", "doc_id")])
def test_names(spark, name, id_col, text_col):
    odd, plain = (
        spark.createDataFrame([(k, t, "en", str(k), 1) for k, t in enumerate(TEXTS)], ["k", "t", "lang", "url", "found"]).withColumnsRenamed(names)
        for names in ({"k": id_col, "t": text_col}, {"k": "doc_id", "t": "text"})
    )
    found, want = OPERATORS[name](odd, id_col, text_col), OPERATORS[name](plain, "doc_id", "text")
    assert id_col in found.columns and [c if c != "doc_id" else id_col for c in want.columns] == found.columns
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, want.collect())))
