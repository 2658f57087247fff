"""Near-duplicate detection by a chosen-path set similarity join on minwise tokens.

1. Every text becomes the set of its word shingles (64-bit fingerprints). Equal sets form a class,
   first within an Arrow batch and then across the table; only one member of a class goes on.
2. ``trees`` independent trees branch the classes by selected minwise tokens, ``BRANCH`` per node.
   A node with at most ``NODE`` members is compared exhaustively by 64-byte sketches (inside, more
   tokens are selected until a part is small). What a node selects follows from its own key, so trees
   over the same members differ. A pair at the threshold survives one node with probability
   1 - 0.2**2 = 0.96 and a tree of any depth with 0.93 or more; below the roots all trees select from
   one sketch, and averaged over its agreement six trees lose the pair with probability 1.2e-6.
3. What nodes find alike falls into groups, over the whole table, that are confirmed on the full sets
   by exact integers. Links are kept as stars, never as all pairs, and joined into components.
4. A node above ``NODE`` members is first dealt into chunks that share pivots, which is linear in
   its size. A node whose members are all in one group then needs no more. In others, where members
   outside the largest group are few (``FEW`` blocks), those meet all members in blocks; else the node branches on by
   further tokens, and children within one group go. Groups above ``GROUP`` are confirmed in chunks
   with pivots, and who is outside the largest component then meets everyone in blocks.
5. Where that would copy a member to more than ``BLOCKS`` blocks (many near misses that share
   boilerplate), members meet by their rare shingles instead, which is exact: boilerplate brings
   nobody together. So no cap drops a partner, and no step emits the pairs of a group.

The sketch test passes a pair at the threshold but for five standard deviations (1.2e-6, binomial).

A text without words, or null, has an empty set, size 0, and is linked with nothing. A text with
fewer words than a shingle has its whole sequence as one shingle. Null ids are never the smallest;
repeated rows are equal sets and share a component. Only the id and text columns are read and
``carry`` columns go through untouched. An empty table gives an empty table.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, field, rows_of, slices, staged, unicode_text, whole_row
from tidemark.llm.components import components

SHINGLE = 5
SIMILAR = 80  # per cent
TREES = 6
#: Tokens selected at a node; the mean of the method, 1 / similarity, rounded up.
BRANCH = 2
SKETCH = 64
#: Members of a node that one task compares, and of a part of it that is compared exhaustively.
NODE = 2048
PART = 384
#: Members of a group whose full sets one task compares.
GROUP = 384
PIVOTS = 48
#: Blocks that a member of a dense group may be copied to.
BLOCKS = 64
#: The same where a node can still branch on.
FEW = 4
#: Levels that an oversize node branches on.
LEVELS = 2
_WORDS_KEPT = 150_000
_COLUMNS = 1 << 14


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    """Sorted distinct fingerprints of a text's shingles."""

    def __init__(self, size: int) -> None:
        self.size, self.words = size, _Words()

    def of_words(self, words: list[bytes]) -> np.ndarray:
        if not words:
            return np.empty(0, np.uint64)
        if len(words) < self.size:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
        if len(self.words) > _WORDS_KEPT:
            self.words.clear()
        ids = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        n = len(ids) - self.size + 1
        h = ids[:n].copy()
        for k in range(1, self.size):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
            h += ids[k : k + n]
        return np.unique(_mix(h))


def _tokens(many: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the minwise hash functions."""
    keys = _mix(np.arange(1, 2 * many + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return keys[:many, None], keys[many:, None] | np.uint64(1)


def minwise(prints: np.ndarray, keys: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least hash of a set under each function."""
    parts = [((prints[i : i + 4096] ^ keys[0]) * keys[1]).min(axis=1) for i in range(0, len(prints), 4096)]
    return _mix(np.minimum.reduce(parts) if len(parts) > 1 else parts[0])


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similar: int = SIMILAR,
    trees: int = TREES, carry: bool = False,
) -> DataFrame:
    """One row per input row: id, ``n_shingles``, ``component_id`` (smallest id reachable), ``kept``
    (the id is that one) and ``survivor`` (exactly one row of each component); with ``carry``, the
    input row too, as the struct ``row``."""
    rows = _sets(docs, id_col, text_col, shingle, trees, carry)
    firsts = rows.where(F.col("d1").isNotNull())
    least = firsts.groupBy("d1", "d2").agg(F.min("rid").alias("cls"))
    classes = cut(firsts.select("rid", "n", "d1", "d2").join(least, ["d1", "d2"]).select("rid", "n", "cls"))
    words = F.col("row").getField(text_col).cast("binary") if carry else F.col("words")
    edges = _links(rows.withColumn("words", words), classes, shingle, similar)
    joined = components(edges).withColumnRenamed("node", "cls")
    own = F.struct(F.col("id").isNull(), "id", "rid")
    members = rows.groupBy("rep").agg(F.min(own).alias("least"))
    found = (
        classes.join(joined, "cls", "left")
        .join(members, F.col("rep") == F.col("rid"))
        .select("rep", "n", F.coalesce("component", "cls").alias("component"), "least")
    )
    best = found.groupBy("component").agg(F.min("least").alias("best"))
    found = found.join(best, "component").select(F.col("rep"), "n", "best")
    return (
        rows.select("id", "rid", F.col("rep"), *(["row"] if carry else []))
        .join(found, "rep", "left")
        .select(
            F.col("id").alias(id_col),
            F.coalesce("n", F.lit(0)).cast("long").alias("n_shingles"),
            F.when(F.col("best").isNull(), F.col("id")).otherwise(F.col("best.id")).alias("component_id"),
            F.when(F.col("best").isNull(), F.lit(True)).otherwise(F.coalesce(F.col("id") == F.col("best.id"), F.lit(False))).alias("kept"),
            F.when(F.col("best").isNull(), F.lit(True)).otherwise(F.col("rid") == F.col("best.rid")).alias("survivor"),
            *(["row"] if carry else []),
        )
    )


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """One row of each component, with the input's columns."""
    return rows_of(near_groups(docs, carry=True, **how).where("survivor"), docs)


def _sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, trees: int, carry: bool) -> DataFrame:
    """Rows with a number ``rid`` and ``rep``, the batch's first row with the same set; that row has
    the set's size, digest, sketch, root tokens and (unless it carries its text) normalised words."""
    roots = trees * BRANCH

    def run(batches):
        rid = TaskContext.get().partitionId() << 40
        shingler, keys = Shingler(shingle), _tokens(SKETCH + roots)
        tree = np.arange(roots, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in slices(batches, "text"):
            first: dict[bytes, int] = {}
            out = {k: [] for k in ("rep", "n", "d1", "d2", "sketch", "roots", "words")}
            for i, raw in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                words = raw.lower().split()
                prints = shingler.of_words(words)
                digest = xxhash.xxh3_128_digest(prints.tobytes()) if len(prints) else b""
                rep = first.setdefault(digest, rid + i)
                out["rep"].append(rep if digest else None)
                if not digest or rep != rid + i:
                    for k in ("n", "d1", "d2", "sketch", "roots", "words"):
                        out[k].append(None)
                    continue
                low = minwise(prints, keys)
                d1, d2 = np.frombuffer(digest, np.int64).tolist()
                values = (len(prints), d1, d2, (low[:SKETCH] >> np.uint64(56)).astype(np.uint8).tobytes(), _mix(low[SKETCH:] ^ tree).view(np.int64).tolist(), None if carry else b" ".join(words))
                for k, v in zip(("n", "d1", "d2", "sketch", "roots", "words"), values, strict=True):
                    out[k].append(v)
            kinds = {"rep": pa.int64(), "n": pa.int64(), "d1": pa.int64(), "d2": pa.int64(), "sketch": pa.binary(), "roots": pa.list_(pa.int64()), "words": pa.binary()}
            held = ["id", *(["row"] if carry else [])]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in held), pa.array(range(rid, rid + len(out["n"])), pa.int64()), *(pa.array(out[k], t) for k, t in kinds.items())],
                names=[*held, "rid", *kinds],
            )
            rid += len(out["n"])

    rows = docs.select(
        field(id_col).alias("id"),
        *([whole_row(docs)] if carry else []),
        unicode_text(text_col).alias("text"),
    )
    schema = T.StructType([f for f in rows.schema.fields if f.name != "text"])
    for name, kind in (("rid", "long"), ("rep", "long"), ("n", "long"), ("d1", "long"), ("d2", "long"), ("sketch", "binary"), ("roots", T.ArrayType(T.LongType())), ("words", "binary")):
        schema = schema.add(name, kind)
    return staged(rows.mapInArrow(run, schema), "near-dedup")


def _links(rows: DataFrame, classes: DataFrame, shingle: int, similar: int) -> DataFrame:
    """Confirmed links (a, b) between classes that connect what is linked."""
    heads = classes.where("rid = cls").select(F.col("rid").alias("cls"))
    firsts = rows.where("d1 is not null")
    own = F.col("rid").alias("cls")
    sketches = firsts.select(own, "n", F.col("rid").alias("group"), "sketch")

    # sketches find groups that may be alike, level by level
    roots = firsts.select(own, F.explode("roots").alias("key")).join(heads, "cls")
    nodes = cut(_sized(roots.select("key", "cls", F.col("cls").alias("component"))))
    alike = cut(_alike(_chunked(nodes, NODE).join(sketches, "cls"), similar))
    groups, wide, level, dense = cut(components(alike)), nodes.where(F.col("m") > NODE), 0, None
    while wide is not None and (rest := _outside(wide, groups)) is not None:
        few = _few(NODE, FEW if level < LEVELS else BLOCKS)
        tasks, many, wide = _blocks(rest.where(few), NODE), rest.where(~few), None
        if many.isEmpty():
            pass
        elif level < LEVELS:
            nodes = cut(_sized(_branched(many.join(sketches, "cls"), level)))
            tasks, wide = tasks.union(_chunked(nodes, NODE)), nodes.where(F.col("m") > NODE)
        else:
            dense = many
        known = tasks.join(sketches, "cls").join(groups.toDF("cls", "known"), "cls", "left").withColumn("group", F.coalesce("known", "group"))
        alike = alike.union(cut(_alike(known, similar)))
        groups, level = cut(components(alike)), level + 1

    # full sets confirm
    texts, groups = firsts.select(own, "words"), groups.toDF("cls", "key")
    groups = cut(groups.join(groups.groupBy("key").agg(F.count("*").alias("m")), "key"))
    edges = _settled(groups, staged(texts.join(groups.select("cls"), "cls"), "near-words"), shingle, similar)
    if dense is None:
        return edges
    return edges.union(_by_rare_shingles(dense, staged(texts.join(dense.select("cls").distinct(), "cls"), "near-words"), shingle, similar))


def _settled(groups: DataFrame, words: DataFrame, shingle: int, similar: int) -> DataFrame:
    """Links of (key, cls, m) groups: in chunks first; who is outside then meets everyone."""
    edges = cut(_confirmed(_chunked(groups, GROUP).join(words, "cls"), shingle, similar))
    rest = _outside(groups.where(F.col("m") > GROUP), components(edges))
    if rest is None:
        return edges
    few, many = rest.where(_few(GROUP, BLOCKS)), rest.where(~_few(GROUP, BLOCKS))
    edges = edges.union(cut(_confirmed(_blocks(few, GROUP).join(words, "cls"), shingle, similar)))
    return edges if many.isEmpty() else edges.union(_by_rare_shingles(many, words, shingle, similar))


def _by_rare_shingles(many: DataFrame, words: DataFrame, shingle: int, similar: int) -> DataFrame:
    """Links of dense groups: their members meet by rare shingles, and in blocks where still more than
    ``GROUP`` share one."""
    groups = cut(_sharing_rare(many, words, shingle, similar))
    edges = cut(_confirmed(_chunked(groups, GROUP).join(words, "cls"), shingle, similar))
    rest = _outside(groups.where(F.col("m") > GROUP), components(edges))
    return edges if rest is None else edges.union(cut(_confirmed(_blocks(rest, GROUP).join(words, "cls"), shingle, similar)))


def _few(most: int, blocks: int) -> Column:
    """Whether so few members are outside a group's largest component that a member is copied to at
    most so many blocks when those meet everyone."""
    return F.ceil(F.col("r") / (most // 2)) <= blocks


def _sized(members: DataFrame) -> DataFrame:
    """(key, cls, m): members, each once, of the nodes that hold more than one component."""
    several = F.min("component") != F.max("component")
    sizes = members.groupBy("key").agg(F.count("*").alias("m"), several.alias("several")).where("several").drop("several")
    return members.select("key", "cls").join(sizes, "key")


def _branched(members: DataFrame, level: int) -> DataFrame:
    """The children of nodes: one for each value of each newly selected token."""
    picks = F.explode(F.array(*[F.lit(j) for j in range(BRANCH)])).alias("j")
    picked = members.select("key", "cls", "component", "sketch", picks)
    at = F.pmod(F.xxhash64("key", F.lit(level), "j"), F.lit(SKETCH)).cast("int") + 1
    token = F.hex(F.substring(F.col("sketch"), at, F.lit(1)))
    return picked.select(F.xxhash64("key", F.lit(level), "j", token).alias("key"), "cls", "component")


def _chunked(sized: DataFrame, most: int) -> DataFrame:
    """(key, sub, cls). Larger groups are dealt into chunks; the same pivots are in each of them."""
    chunks = F.when(F.col("m") > most, F.ceil(F.col("m") / (most - PIVOTS))).otherwise(1)
    pivot = (F.col("m") > most) & (F.pmod(F.xxhash64("cls", F.lit(7)), F.col("m")) < PIVOTS // 2)
    own = F.array(F.pmod(F.xxhash64("cls", F.lit(11)), chunks))
    subs = F.when(pivot, F.sequence(F.lit(0).cast("long"), chunks.cast("long") - 1)).otherwise(own)
    return sized.select("key", F.explode(subs).alias("sub"), "cls")


def _sharing_rare(rest: DataFrame, words: DataFrame, shingle: int, similar: int) -> DataFrame:
    """(key, cls, m): the members of a group by each of their rarest shingles within it. Of two linked
    sets at least one of the rarest ``n - ceil(n * similar / 100) + 1`` shingles of each is shared, so
    no link is lost; what a group shares as boilerplate is common there and brings nobody together.
    The groups that hold only members of the largest component go."""

    def run(batches):
        shingler = Shingler(shingle)
        for batch in slices(batches, "words"):
            for key, cls, out, text in zip(*(batch.column(c).to_pylist() for c in ("key", "cls", "out", "words")), strict=True):
                prints = shingler.of_words(text.lower().split()).view(np.int64)
                same = lambda v, n=len(prints): pa.array(np.full(n, v, np.int64))
                yield pa.RecordBatch.from_arrays([same(key), same(cls), same(out), same(len(prints)), pa.array(prints)], names=["key", "cls", "out", "n", "print"])

    prints = staged(rest.select("key", "cls", F.col("out").cast("long").alias("out")).join(words, "cls").mapInArrow(run, "key long, cls long, out long, n long, print long"), "near-rare")
    often = prints.groupBy("key", "print").agg(F.count("*").alias("df"), F.sum("out").alias("outside"))
    placed = F.row_number().over(Window.partitionBy("key", "cls").orderBy("df", "print"))
    ranked = prints.join(often, ["key", "print"]).withColumn("place", placed)
    first = ranked.where((F.col("place") <= F.col("n") - F.ceil(F.col("n") * similar / 100) + 1) & (F.col("outside") > 0))
    # a member outside is a component of its own here, so that groups of them stay
    own = F.when(F.col("out") > 0, F.col("cls")).otherwise(-1)
    return _sized(first.select(F.xxhash64("key", "print").alias("key"), "cls", own.alias("component")))


def _outside(groups: DataFrame, known: DataFrame) -> DataFrame | None:
    """(key, cls, m, component, r, out) of the groups (key, cls, m) that (node, component) leaves in
    several components; ``out``: not in the group's largest; ``r``: how many aren't. None if there is
    no such group. What is within one component needs no further search."""
    if groups.isEmpty():
        return None
    held = cut(groups.join(known.toDF("cls", "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls")))
    sizes = held.groupBy("key", "component").agg(F.count("*").alias("size"))
    top = sizes.groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("top"), F.max("size").alias("size"))
    rest = held.join(top, "key").withColumn("r", F.col("m") - F.col("size")).where("r > 0")
    rest = cut(rest.select("key", "cls", "m", "component", "r", (F.col("component") != F.col("top")).alias("out")))
    return None if rest.isEmpty() else rest


def _blocks(rest: DataFrame, most: int) -> DataFrame:
    """(key, sub, cls): every member that is outside meets every member, in blocks."""
    half = most // 2
    a, b = F.ceil(F.col("r") / half), F.ceil(F.col("m") / half)
    to = lambda n: F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)
    mine = F.pmod(F.xxhash64("cls", F.lit(13)), b)
    every = rest.select("key", "cls", F.transform(to(a), lambda i: i * b + mine).alias("subs"))
    outside = rest.where("out").select("key", "cls", F.transform(to(b), lambda j: F.pmod(F.xxhash64("cls", F.lit(17)), a) * b + j).alias("subs"))
    return every.union(outside).select("key", F.explode("subs").alias("sub"), "cls").distinct()


def _by_group(rows: DataFrame, columns: list[str], compare, schema: str) -> DataFrame:
    """``compare((key, sub), list of group columns)`` for each of them, streamed over sorted partitions."""

    def run(batches):
        held: list[pa.RecordBatch] = []

        def groups(at_end: bool):
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            if not table.num_rows:
                return
            key, sub = table.column("key").to_numpy(), table.column("sub").to_numpy()
            new = np.flatnonzero((key[1:] != key[:-1]) | (sub[1:] != sub[:-1])) + 1
            edges = [0, *new.tolist(), len(key)]
            stop = len(edges) - 1 if at_end else len(edges) - 2
            values = [table.column(c).to_pylist() for c in columns]
            for a, b in zip(edges[:stop], edges[1 : stop + 1], strict=True):
                if b - a > 1:
                    yield (int(key[a]), int(sub[a])), [v[a:b] for v in values]
            held = [] if at_end else table.slice(edges[-2]).to_batches()

        for batch in slices(batches, columns[-1]):
            held.append(batch)
            found = [x for group in groups(False) for x in compare(*group)]
            yield _pairs(found, schema)
        if held:
            yield _pairs([x for group in groups(True) for x in compare(*group)], schema)

    dealt = rows.select("key", "sub", *columns).repartition("key", "sub").sortWithinPartitions("key", "sub", "cls")
    return dealt.mapInArrow(run, schema)


def _pairs(found: list[tuple[int, int]], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    a, b = zip(*found, strict=True) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=names)


class _Joined:
    """Union-find over 0..n-1."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)

    def stars(self, names: list[int]) -> list[tuple[int, int]]:
        """(name of the least of a part, name) for parts of at least two, the least included."""
        roots = [self.root(i) for i in range(len(names))]
        shared = {r for i, r in enumerate(roots) if r != i}
        return [(names[r], names[i]) for i, r in enumerate(roots) if r in shared]


def _alike(rows: DataFrame, similar: int) -> DataFrame:
    """Links (a, b), as stars, of classes that a node's sketches connect. Pairs with the same ``group``
    will be confirmed anyway."""
    p = similar / 100
    least = math.floor(SKETCH * p - 5 * math.sqrt(SKETCH * p * (1 - p)))

    def compare(node, group):
        names, sizes, known, sketches = group
        size, sketch = np.array(sizes), np.frombuffer(b"".join(sketches), np.uint8).reshape(len(names), SKETCH)
        joined = _Joined(len(names))
        _search(np.arange(len(names)), 0, xxhash.xxh3_64_intdigest(repr(node)), size, sketch, np.array(known), joined, similar, least)
        return joined.stars(names)

    return _by_group(rows, ["cls", "n", "group", "sketch"], compare, "a long, b long").where("a <> b").distinct()


def _picks(seed: int) -> list[int]:
    """``BRANCH`` different sketch positions."""
    ranked = sorted(range(SKETCH), key=lambda at: xxhash.xxh3_64_intdigest(at.to_bytes(1, "little"), seed))
    return ranked[:BRANCH]


def _search(members: np.ndarray, depth: int, seed: int, size: np.ndarray, sketch: np.ndarray, known: np.ndarray, joined: _Joined, similar: int, least: int) -> None:
    """Branch a large part by selected tokens; compare a small one exhaustively. The selection follows
    from the node's own key and the path, as in ``_branched``: trees over the same members differ."""
    if len(members) > PART and depth < 4:
        picks = _picks(seed)
        parts = [(pick, v, members[sketch[members, pick] == v]) for pick in picks for v in np.unique(sketch[members, pick]).tolist()]
        if max(len(part) for _, _, part in parts) < 0.8 * len(members):
            for pick, v, part in parts:
                if len(part) > 1:
                    _search(part, depth + 1, xxhash.xxh3_64_intdigest(repr((pick, v)), seed), size, sketch, known, joined, similar, least)
            return
    own, n, group = sketch[members], size[members], known[members]
    for i in range(len(members) - 1):
        same = np.count_nonzero(own[i + 1 :] == own[i], axis=1)
        fits = (same >= least) & (100 * np.minimum(n[i + 1 :], n[i]) >= similar * np.maximum(n[i + 1 :], n[i]))
        fits &= group[i + 1 :] != group[i]
        for j in np.flatnonzero(fits).tolist():
            joined.join(int(members[i]), int(members[i + 1 + j]))


def _confirmed(rows: DataFrame, shingle: int, similar: int) -> DataFrame:
    """Links (a, b) as stars, from the exact intersections of all pairs of a group."""
    shinglers: list[Shingler] = []

    def compare(_, group):
        if not shinglers:
            shinglers.append(Shingler(shingle))
        names, words = group
        return exact_links([shinglers[0].of_words(w.lower().split()) for w in words], similar).stars(names)

    stars = _by_group(rows, ["cls", "words"], compare, "a long, b long")
    return stars.where("a <> b")


def exact_links(sets: list[np.ndarray], similar: int) -> _Joined:
    """Parts of the sets that are linked by 100 * intersection >= similar * union."""
    joined, m = _Joined(len(sets)), len(sets)
    size = np.array([len(s) for s in sets])
    if m <= 6:
        for i in range(m):
            for j in range(i + 1, m):
                both = _common(sets[i], sets[j])
                if both and 100 * both >= similar * (size[i] + size[j] - both):
                    joined.join(i, j)
        return joined
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), size)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    both = np.zeros((m, m), np.float64)
    for start in range(0, len(values), _COLUMNS):
        a, b = np.searchsorted(column, (start, start + _COLUMNS))
        has = np.zeros((m, min(_COLUMNS, len(values) - start)), np.float32)
        has[row[a:b], column[a:b] - start] = 1
        both += has @ has.T
    either = size[:, None] + size[None, :] - both
    for i, j in zip(*np.nonzero(np.triu((both > 0) & (100 * both >= similar * either), 1)), strict=True):
        joined.join(int(i), int(j))
    return joined


def _common(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))
