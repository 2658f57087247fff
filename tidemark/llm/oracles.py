"""DuckDB SQL for the operators that SQL can express.

Exact token counts, language models, entropy spans and packing have no practical SQL form; tests
hold those against the tokenizer libraries, brute force or held-out rows.
"""

from __future__ import annotations

from tidemark.llm import fixity, license_scan, sharding, vector_codes

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = r"[\x20\x09-\x0D]+"


#: The byte table of the CRC-32.
_CRC = "crc AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8), lambda acc, k: CASE WHEN acc % 2 = 1 THEN xor(acc // 2, 3988292384) ELSE acc // 2 END, i) AS x FROM range(0, 256) z(i)))"


def _exact_dedup() -> str:
    return rf"""WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n"""


def _near_dedup() -> str:
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_SPACE}'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
ln AS (SELECT a, b FROM pr JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
rc(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT rc.doc_id, ln.b FROM rc JOIN ln ON ln.a = rc.reach),
cm AS (SELECT doc_id, min(reach) AS component_id FROM rc GROUP BY 1)
SELECT cm.doc_id, coalesce(n, 0) AS n_shingles, component_id, cm.doc_id = component_id AS kept FROM cm LEFT JOIN sz ON sz.doc_id = cm.doc_id"""


def _fixity() -> str:
    record = "'WARC/1.1' || crlf || 'WARC-Type: resource' || crlf || 'WARC-Record-ID: <urn:page:' || page_id || '>' || crlf || 'WARC-Target-URI: ' || coalesce(url, '') || crlf || 'Content-Length: ' || strlen(body) || crlf || crlf || body || crlf || crlf"
    side = lambda source: f"""SELECT *, "end" - size AS start FROM (SELECT file, page_id, sha256(rec) AS digest, strlen(rec) AS size, row_number() OVER w - 1 AS nth, CAST(sum(strlen(rec)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM (SELECT *, {record} AS rec FROM {source}) WINDOW w AS (PARTITION BY file ORDER BY page_id, url, sha256(rec)))"""
    return f"""WITH p AS (SELECT *, chr(13) || chr(10) AS crlf, page_id // {fixity.FILE_RECORDS} AS file, coalesce(html, '') AS body FROM pages),
c AS (SELECT page_id, url, crlf, file, CASE page_id % 97 WHEN 5 THEN substr(body, 2) || substr(body, 1, 1) ELSE body END AS body FROM p WHERE page_id % 4999 <> 31
  UNION ALL SELECT page_id + 1000000000000, url, crlf, file, body FROM p WHERE page_id % 97 = 59),
l AS ({side("p")}), r AS ({side("c")})
SELECT CAST(coalesce(l.file, r.file) AS VARCHAR) AS file, coalesce(l.page_id, r.page_id) AS page_id, l.start, l."end", l.digest, r.start AS replica_start, r."end" AS replica_end, r.digest AS replica_digest,
  CASE WHEN r.page_id IS NULL THEN 'missing' WHEN l.page_id IS NULL THEN 'extra' WHEN l.digest <> r.digest THEN 'altered' ELSE 'moved' END AS damage
FROM l FULL JOIN r ON l.file = r.file AND l.page_id = r.page_id WHERE (l.nth, l.start, l."end", l.digest) IS DISTINCT FROM (r.nth, r.start, r."end", r.digest)"""


def _sharding() -> str:
    prime = (1 << 31) - 1
    step = "SELECT row_number, walks, a, b, n, v % a AS l, v // a AS r FROM base"
    for i, (x, y, z) in enumerate(sharding.round_keys(sharding.SEED)):
        own, other, side = ("l", "r", "a") if i % 2 == 0 else ("r", "l", "b")
        mixed = f"SELECT *, ({other} * {x} + {y}) % {prime} AS m FROM ({step})"
        new = f"({own} + (m * m + {z}) % {prime}) % {side}"
        l, r = (new, "r") if own == "l" else ("l", new)
        step = f"SELECT row_number, walks, a, b, n, {l} AS l, {r} AS r FROM ({mixed})"
    once = lambda source: f"SELECT row_number, walks + 1 AS walks, a, b, n, r * a + l AS v FROM ({step.replace('FROM base', f'FROM {source}')})"
    return f"""WITH RECURSIVE {_CRC},
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
e AS (SELECT doc_id, size, xor(list_reduce(list_transform(range(0, size - 1), lambda k: CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT)), lambda acc, x: xor(acc // 256, t[xor(acc % 256, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS text_crc32 FROM d, crc),
k AS (SELECT *, row_number() OVER (ORDER BY doc_id, size, text_crc32) - 1 AS row_number, count(*) OVER () AS n FROM e),
start AS (SELECT row_number, 0 AS walks, CAST(ceil(sqrt(n)) AS BIGINT) AS a, CAST(ceil(n / ceil(sqrt(n))) AS BIGINT) AS b, n, row_number AS v FROM k),
walk(row_number, walks, a, b, n, v) AS ({once("start")} UNION ALL {once("(SELECT * FROM walk WHERE v >= n)")})
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(v % {sharding.SHARDS} AS INTEGER) AS shard, v // {sharding.SHARDS} AS slot, CAST(NULL AS INTEGER) AS grown_shard, k.row_number FROM k JOIN walk ON walk.row_number = k.row_number AND v < walk.n"""


def _licences() -> str:
    known = ", ".join(f"'{text}': '{name}'" for name, text in license_scan.SENTENCES.items())
    fired = ", ".join(f"CASE WHEN regexp_matches(s, '{license_scan.pattern(*rule)}') THEN '{name}' END" for name, *rule in [*license_scan.RULES, *license_scan.NOTICES])
    return rf"""WITH p AS (SELECT doc_id, lower(regexp_replace(regexp_replace(coalesce(text, ''), '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), '[^A-Za-z0-9\n]+', ' ', 'g')) AS t FROM documents),
q AS (SELECT doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM p),
r AS (SELECT doc_id, len(ss) AS n_sentences, list_filter(list_transform(ss, lambda x: (MAP {{{known}}})[x]), lambda x: x IS NOT NULL) AS ids FROM q),
u AS (SELECT *, ' ' || coalesce(array_to_string(ids, ' '), '') || ' ' AS s FROM r)
SELECT doc_id, n_sentences, CAST(len(ids) AS BIGINT) AS n_known, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(list_sort(list_distinct([{fired}])), ','), '') AS licences FROM u"""


def _decontamination() -> str:
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""WITH bw AS (SELECT item_id, {words} AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS size, array_to_string(list_slice(ws, k, k + least(10, len(ws)) - 1), ' ') AS w FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS k FROM bw WHERE len(ws) > 0)),
dw AS (SELECT doc_id, {words} AS ws FROM documents),
dk AS (SELECT doc_id, size, k, array_to_string(list_slice(ws, k, k + size - 1), ' ') AS w FROM (SELECT doc_id, ws, size, unnest(range(1, len(ws) - size + 2)) AS k FROM dw, (SELECT DISTINCT size FROM win))),
hit AS (SELECT doc_id, k, dk.size, item_id FROM dk JOIN win ON win.size = dk.size AND win.w = dk.w),
cov AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS x FROM hit) GROUP BY 1),
own AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT dw.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov ON cov.doc_id = dw.doc_id LEFT JOIN own ON own.doc_id = dw.doc_id"""


def _conversation_trie() -> str:
    return f"""WITH {_CRC},
o AS (SELECT conv_id AS c, list({{'r': coalesce(role, ''), 'x': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS ts FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
h AS (SELECT c, ts, c - c % 5 AS base, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda acc, x: xor(acc // 256, t[xor(acc % 256, x) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h FROM o, crc),
rb AS (SELECT h.c, list_concat(list_slice(coalesce(b.ts, []), 1, h), list_slice(h.ts, h + 1, len(h.ts))) AS ts FROM h LEFT JOIN o b ON b.c = h.base),
px AS (SELECT c, d, list_slice(ts, 1, d) AS p, len(ts) = d AS ending FROM (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM rb)),
nd AS (SELECT p, d, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE strlen(p[d].x) END AS own, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (WHERE ending), '')) AS ends_sha256 FROM px GROUP BY 1, 2),
kid AS (SELECT list_slice(p, 1, d - 1) AS p, count(*) AS n_children FROM nd WHERE d > 0 GROUP BY 1),
al AS (SELECT nd.*, coalesce(n_children, 0) AS n_children FROM nd LEFT JOIN kid ON kid.p = nd.p),
sub AS (SELECT list_slice(p, 1, k) AS p, sum(own) AS saved, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves FROM (SELECT p, own, n_children, unnest(range(0, d + 1)) AS k FROM al) GROUP BY 1)
SELECT al.conv_id, al.d AS depth, up.conv_id AS parent_conv_id, al.n_convs, al.n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, al.ends_sha256
FROM al JOIN sub ON sub.p = al.p LEFT JOIN nd up ON al.d > 0 AND up.p = list_slice(al.p, 1, al.d - 1)"""


def _vector_codes() -> str:
    """For vectors of 64 components, as the tables have them."""
    parts, entries, m = vector_codes.PARTS, vector_codes.ENTRIES, 8
    apart = " + ".join(f"(x[{i}] - e[{i}]) * (x[{i}] - e[{i}])" for i in range(1, m + 1))
    steps = [f"b0 AS MATERIALIZED (SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS INTEGER) AS k, x AS e FROM px QUALIFY k < {entries})"]
    for r in range(vector_codes.ROUNDS + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, p, any_value(x) AS x, min(struct_pack(d := {apart}, k := k)) AS best FROM px JOIN b{r} USING (p) GROUP BY vec_id, p)")
        if r < vector_codes.ROUNDS:
            means = ", ".join(f"CAST(floor(sum(x[{i}]) / count(*)) AS BIGINT)" for i in range(1, m + 1))
            steps.append(f"b{r + 1} AS MATERIALIZED (SELECT b{r}.p, b{r}.k, coalesce(n.e, b{r}.e) AS e FROM b{r} LEFT JOIN (SELECT p, best.k AS k, [{means}] AS e FROM a{r} GROUP BY 1, 2) n ON n.p = b{r}.p AND n.k = b{r}.k)")
    last = vector_codes.ROUNDS
    return f"""WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {parts * m} AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
px AS MATERIALIZED (SELECT vec_id, p, list_slice(v, {m} * p + 1, {m} * p + {m}) AS x FROM kept, range(0, {parts}) z(p)),
{", ".join(steps)},
cb AS (SELECT sha256(string_agg(array_to_string(e, ','), ',' ORDER BY p, k)) AS codebooks_sha256 FROM b{last}),
cd AS (SELECT vec_id, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a{last} GROUP BY 1)
SELECT kept.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN cd ON cd.vec_id = kept.vec_id, cb"""


SQL: dict[str, str] = {
    "op2_minhash_near_dedup": _near_dedup(),
    "op3_warc_fixity": _fixity(),
    "op4_exact_dedup": _exact_dedup(),
    "op5_sharding": _sharding(),
    "op7_license_scan": _licences(),
    "op10_decontamination": _decontamination(),
    "op11_conversation_trie": _conversation_trie(),
    "op12_vector_codes": _vector_codes(),
}
