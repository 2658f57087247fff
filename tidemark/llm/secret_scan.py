"""Secret scan: three fixed patterns and sliding-window entropy per character class.

Base spans are the leftmost non-overlapping matches of each pattern that are long enough. The
entropy pass looks at candidate strings (long runs of one character class), slides a window over
each and keeps the Shannon entropy of the window by updating only the counts of the character that
enters and the one that leaves. Windows above the class's threshold are merged into a span, unless
the whole candidate or a string that the window overlaps is on the allow-list. Entropy spans are
added; base spans are never suppressed.

Offsets are code points, end exclusive. Null text counts as empty. Null or repeated ids and
repeated rows go through row for row; only the id and text columns are read. An empty table gives an
empty table. A text's work is linear in its length.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import field, slices, unicode_text

_KEYS = ("password", "passwd", "secret", "token", "api_?key")
_EITHER_CASE = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in key) for key in _KEYS)
ASSIGN = re.compile(rf"(?:{_EITHER_CASE})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Fewest characters: of group 2 of an assignment, of an access key, of a hex run.
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_lower", "entropy_upper")

_LOWER, _UPPER, _DIGIT = re.compile("[a-z]"), re.compile("[A-Z]"), re.compile("[0-9]")
#: Candidate runs per class, window width, bits per character from which a window counts if it has all
#: of the listed characters, and bits from which it counts without. Half a per cent of random windows
#: of 20 is below 3.35 bits in [a-z0-9] or [A-Z0-9] and below 3.61 in base64 (100,000 drawn of each).
CLASSES = {
    "entropy_hex": (re.compile(r"(?<![0-9A-Za-z])[0-9A-Fa-f]{20,}(?![0-9A-Za-z])"), 20, 3.0, (), 3.0),
    "entropy_base64": (re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:={1,2}(?![A-Za-z0-9+/_=-]))?"), 20, 3.6, (_LOWER, _UPPER, _DIGIT), 3.85),
    "entropy_lower": (re.compile(r"(?<![0-9A-Za-z])(?![0-9a-f]+(?![0-9A-Za-z]))[0-9a-z]{20,}(?![0-9A-Za-z])"), 20, 3.34, (_LOWER, _DIGIT), math.inf),
    "entropy_upper": (re.compile(r"(?<![0-9A-Za-z])(?![0-9A-F]+(?![0-9A-Za-z]))[0-9A-Z]{20,}(?![0-9A-Za-z])"), 20, 3.34, (_UPPER, _DIGIT), math.inf),
}
#: A candidate that one of these matches isn't a secret.
ALLOWED = (
    re.compile(r"^(.{1,4}?)\1+.?$"),  # a short unit over and over
    # letters only: words and paths, and the 3 per cent of random base64 keys of 20 without a digit
    re.compile(r"^[A-Za-z]+$|^[A-Za-z]+(?:[-_/][A-Za-z]+)+$"),
    re.compile(r"^[0-9]+$"),  # numbers
)
#: A window that overlaps one of these doesn't count.
ALLOWED_PART = re.compile(r"(?i)example|sample|placeholder|changeme|dummy|redacted|x{4,}|0123456789|abcdefgh")


def window_spans(
    candidate: str, width: int, threshold: float, needs: tuple[re.Pattern, ...] = (), sure: float | None = None, but: list[tuple[int, int]] | None = None,
) -> list[tuple[int, int]]:
    """Merged windows of ``candidate`` whose entropy is at least ``threshold`` bits a character and
    that have a match of all of ``needs``, or whose entropy is at least ``sure``; no window that
    overlaps a span of ``but`` counts."""
    if len(candidate) < width:
        return []
    gain = [0.0] + [n * math.log2(n) for n in range(1, width + 1)]
    counts: Counter[str] = Counter(candidate[:width])
    total = sum(gain[n] for n in counts.values())
    least = (math.log2(width) - threshold) * width + 1e-9  # entropy = log2(w) - sum(n log2 n) / w
    surely = least if sure is None else (math.log2(width) - sure) * width + 1e-9
    out = {at for a, b in but or () for at in range(a - width + 1, b)}
    spans: list[tuple[int, int]] = []
    for start in range(len(candidate) - width + 1):
        if start:
            gone, come = candidate[start - 1], candidate[start + width - 1]
            n = counts[gone]
            total += gain[n - 1] - gain[n]
            counts[gone] = n - 1
            n = counts[come]
            total += gain[n + 1] - gain[n]
            counts[come] = n + 1
        if total <= least and start not in out and (total <= surely or all(need.search(candidate, start, start + width) for need in needs)):
            if spans and spans[-1][1] >= start:
                spans[-1] = (spans[-1][0], start + width)
            else:
                spans.append((start, start + width))
    return spans


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= LEAST["assign"]]
    found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return found


def entropy_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    for kind, (pattern, width, threshold, needs, sure) in CLASSES.items():
        for m in pattern.finditer(text):
            if not any(allowed.search(m.group()) for allowed in ALLOWED):
                but = [part.span() for part in ALLOWED_PART.finditer(m.group())]
                found += [(kind, m.start() + a, m.start() + b) for a, b in window_spans(m.group(), width, threshold, needs, sure, but)]
    return found


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in in_order(spans))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and ``found``, an array of (kind, start, end, matched text), in
    order of start and then kind."""

    def run(batches):
        for batch in slices(batches, "text"):
            rows = []
            for text in batch.column("text").to_pylist():
                spans = in_order(base_spans(text) + entropy_spans(text))
                rows.append([{"kind": k, "start": a, "end": b, "match": text[a:b]} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(rows, _FOUND)], names=["id", "found"])

    rows = docs.select(field(id_col).alias("id"), unicode_text(text_col).alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("found", _SPANS)])).withColumnRenamed("id", id_col)


_SPANS = T.ArrayType(T.StructType().add("kind", "string").add("start", "long").add("end", "long").add("match", "string"))
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("match", pa.string())]))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the checksum of the base spans and all spans as text."""
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    count = lambda kind: F.size(F.filter("found", lambda s: s.kind == kind)).cast("long")
    base = F.filter("found", lambda s: s.kind.isin("assign", "access", "hex"))
    return scanned.select(
        field(id_col),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("found")).alias("spans"),
    )


def redacted(text: str) -> str:
    """``text`` with every found span masked."""
    out, at = [], 0
    for _, a, b in in_order(base_spans(text) + entropy_spans(text)):
        if b > at:
            out += [text[at:a], "*" * (b - max(a, at))]
            at = b
    return "".join(out) + text[at:]
