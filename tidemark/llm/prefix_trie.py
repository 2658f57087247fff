"""The trie of all prefixes that conversations share, with counts and savings for each node.

1. Each turn becomes a 16-byte key of its role and text, a conversation the string of its keys.
   Equal conversations meet first: one row for each distinct sequence, with the number of its
   conversations, the least id, and the digest of all ids, which is fed with runs of ids in order.
2. The distinct sequences are sorted over all tasks. Neighbours have a longest common prefix, the
   depth of the edge between them. Union-find takes a task's edges in descending depth; whenever two
   components merge at a new depth, a branching node is made. Nodes with one child in between are
   not made yet: each branching node stands for the chain that leads to it.
3. Components at the ends of a task's range may go on in the next one. They are contracted to a few
   rows, one for each depth at which the first or the last sequence branches, and ranges are merged
   across their boundaries by the same union-find, ``FAN`` at a time, until one is left. A node whose
   parent isn't known yet points at a branch of its range, and learns the parent once that is merged.
4. Every number of a node is a sum over its range of sequences, so chains are unfolded at the end.

What contraction leaves grows with the number of ranges and the length of a conversation, not with the
number of conversations. Sequences are one row each: 16 bytes a turn. Keys are the first half of a
SHA-256, so a chance clash is possible in principle.

Turns are ordered by number, null first, then by role and key; null roles and texts count as empty.
Rows without a conversation id belong to none and are left out. Repeated rows are turns of their own.
A conversation may have no turns. Only the named columns are read. No conversations: no nodes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, field, staged

KEY = 16
#: Ranges that are merged at once.
FAN = 64
#: Ids whose rows are joined into one run before the digest is fed.
RUN_BITS = 10
_NO_DEPTH = 1 << 60

ELEMENT = "rep long, least long, n long, total long, first_total long, first_len long, first_ends string, seqs long, inside long, grown long, last_len long, own boolean"
EDGE = "depth long, shared long, count long, side int"
#: What a merge returns: nodes, contracted elements with the edge before them, and pointers.
ROWS = f"kind string, part long, at long, {ELEMENT}, {EDGE}, seq binary, upto array<long>, node_depth long, top long, kids long, leaves long, weight long, parent long, up_part long, up_side int, up_depth long"
NAMES = [c.split()[0] for c in ROWS.split(", ")]


def turns(table: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, turns): each conversation's turns in order, as structs of ``key`` (hex) and ``size`` (bytes of the text)."""
    role, text = F.coalesce(field(role_col), F.lit("")), F.coalesce(field(text_col), F.lit(""))
    key = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY)
    turn = field(turn_col)
    one = F.struct(turn.isNotNull().alias("told"), turn.alias("turn"), role.alias("role"), key.alias("key"), F.octet_length(text).alias("size"))
    grouped = table.where(field(conv_col).isNotNull()).groupBy(field(conv_col).alias("id")).agg(F.sort_array(F.collect_list(one)).alias("t"))
    return grouped.select("id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["size"].alias("size"))).alias("turns"))


def distinct_sequences(rows: DataFrame) -> DataFrame:
    """(seq, rep, n, ends, upto) from (id, turns), ids being unique: distinct sequences, their least
    conversation, how many there are, the digest of their ids, and the bytes before each turn."""
    keyed = rows.select("id", F.unhex(F.array_join(F.col("turns.key"), "")).alias("seq"), F.col("turns.size").alias("sizes"))
    runs = keyed.groupBy("seq", F.shiftright("id", RUN_BITS).alias("run")).agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("sizes").alias("sizes"))
    runs = runs.select("seq", "run", F.col("ids")[0].alias("least"), F.size("ids").alias("n"), F.concat_ws(",", F.col("ids").cast("array<string>")).alias("ids"), "sizes")

    def digest(batches):
        held = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held is None or held[0] != r["seq"]:
                    if held:
                        out.append(held)
                    held = [r["seq"], r["least"], 0, hashlib.sha256(), [0, *np.cumsum(r["sizes"], dtype=np.int64).tolist()]]
                else:
                    held[3].update(b",")
                held[2] += r["n"]
                held[3].update(r["ids"].encode())
            yield told(out)
        if held:
            yield told([held])

    def told(out):
        columns = [[x[0] for x in out], [x[1] for x in out], [x[2] for x in out], [x[3].hexdigest() for x in out], [x[4] for x in out]]
        kinds = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["seq", "rep", "n", "ends", "upto"])

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_runs = runs.repartition(tasks, "seq").sortWithinPartitions("seq", "run")
    return staged(sorted_runs.mapInArrow(digest, "seq binary, rep long, n long, ends string, upto array<long>"), "sequences")


def common(a: bytes, b: bytes) -> int:
    """Turns that two sequences share at their beginning."""
    m = min(len(a), len(b))
    if a[:m] == b[:m]:
        return m // KEY
    return int((np.frombuffer(a, np.uint8, m) != np.frombuffer(b, np.uint8, m)).argmax()) // KEY


class Range:
    """Neighbouring elements, each a sequence or a contracted run of them, and the edges between.

    Of an element: ``rep`` and ``first_*`` belong to its first sequence, ``last_len`` to its last;
    ``inside`` are the bytes that its other sequences add to the trie, ``grown`` the sequences that a
    longer one goes on from; ``own``: a single sequence whose node isn't made yet. Edge k lies before
    element k; ``shared`` are the bytes of the common prefix, ``count`` the branches it stands for."""

    def __init__(self, elements: pd.DataFrame, edges: pd.DataFrame) -> None:
        self.e, self.k = elements.reset_index(drop=True), edges.reset_index(drop=True)
        self.m = len(self.e)
        column = {c: self.e[c].to_numpy() for c in ("n", "total", "first_total", "first_len", "seqs", "inside", "grown", "last_len")}
        depth, shared = self.k["depth"].to_numpy(np.int64), self.k["shared"].to_numpy(np.int64)
        self.new = column["first_total"].astype(np.int64) - shared
        self.on = np.append(False, column["last_len"][:-1] == depth[1:]).astype(np.int64)
        self.new[0] = 0
        cum = lambda x: np.append(0, np.cumsum(x.astype(np.int64)))
        self.sums = {c: cum(column[c]) for c in ("n", "total", "seqs", "inside", "grown")} | {"new": cum(self.new), "on": cum(self.on)}

    def total(self, name: str, lo: int, hi: int) -> int:
        return int(self.sums[name][hi + 1] - self.sums[name][lo])

    def merge(self) -> None:
        """Union-find over the edges in descending depth, from left to right within a depth."""
        m, least, first_len = self.m, self.e["least"].tolist(), self.e["first_len"].tolist()
        depth, count = self.k["depth"].tolist(), self.k["count"].tolist()
        self.lo, self.hi, self.least = list(range(m)), list(range(m)), least
        self.depth = [n if own else _NO_DEPTH for n, own in zip(first_len, self.e["own"], strict=True)]
        self.kids, self.up, self.edge_node = [0] * m, [None] * m, [None] * m
        root, node = list(range(m)), list(range(m))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        ranked = np.argsort(-self.k["depth"].to_numpy(np.int64)[1:], kind="stable") + 1 if m > 1 else []
        for k in map(int, ranked):
            a, b, d = find(k - 1), find(k), depth[k]
            na, nb = node[a], node[b]
            if self.depth[na] != d:
                self.up[na] = new = len(self.lo)
                for held, value in ((self.lo, self.lo[na]), (self.hi, 0), (self.least, self.least[na]), (self.depth, d), (self.kids, int(first_len[self.lo[na]] > d)), (self.up, None)):
                    held.append(value)
                na = new
            self.up[nb], self.hi[na] = na, self.hi[nb]
            self.least[na] = min(self.least[na], self.least[nb])
            self.kids[na] += count[k]
            self.edge_node[k] = na
            root[b], node[a] = a, na

    def is_open(self, x: int, final: bool) -> bool:
        return not final and (self.lo[x] == 0 or self.hi[x] == self.m - 1)

    def side(self, x: int) -> int:
        return 0 if self.lo[x] == 0 else 1

    def nodes(self, part: int, final: bool):
        """The branching nodes that end within the range, with the chain that leads to each."""
        reps, ends, first = self.e["rep"].tolist(), self.e["first_ends"].tolist(), self.e["first_total"].tolist()
        first_len = self.e["first_len"].tolist()
        for x, d in enumerate(self.depth):
            if d == _NO_DEPTH or self.is_open(x, final):
                continue
            lo, hi, up = self.lo[x], self.hi[x], self.up[x]
            row = {"kind": "node", "part": part, "rep": reps[lo], "node_depth": d, "least": self.least[x], "kids": self.kids[x]}
            row |= {c: self.total(c, lo, hi) for c in ("n", "total")}
            row["weight"] = first[lo] + self.total("inside", lo, hi) + self.total("new", lo + 1, hi)
            row["leaves"] = self.total("seqs", lo, hi) - self.total("grown", lo, hi) - self.total("on", lo + 1, hi)
            row["first_ends"] = ends[lo] if first_len[lo] == d else None
            row["top"] = 0 if up is None else self.depth[up] + 1
            if up is not None and self.is_open(up, final):
                row |= {"up_part": part, "up_side": self.side(up), "up_depth": self.depth[up]}
            elif up is not None:
                row["parent"] = self.least[up]
            yield row

    def pointers(self, part: int, final: bool):
        """Where the branches of the merged ranges have come to."""
        for k in range(1, self.m):
            if pd.isna(self.k["side"][k]):
                continue
            x = self.edge_node[k]
            row = {"kind": "pointer", "part": int(self.k["part"][k]), "side": int(self.k["side"][k]), "depth": self.depth[x]}
            yield row | ({"up_part": part, "up_side": self.side(x), "up_depth": self.depth[x]} if self.is_open(x, final) else {"parent": self.least[x]})

    def contracted(self, part: int):
        """The elements between the edges that are lower than all on one side of them."""
        depth = self.k["depth"].tolist()
        left, right = [], []
        for k in range(1, self.m):
            if not left or depth[k] < depth[left[-1]]:
                left.append(k)
        for k in range(self.m - 1, 0, -1):
            if not right or depth[k] < depth[right[-1]]:
                right.append(k)
        kept = sorted({*left, *right})
        begins = [0, *kept]
        for at, (a, b) in enumerate(zip(begins, [*kept, self.m], strict=True)):
            b -= 1
            row = {"kind": "element", "part": part, "at": at, "own": bool(self.e["own"][a]) and a == b and (a == 0 or b == self.m - 1)}
            row |= {c: self.e[c][a] for c in ("rep", "first_total", "first_len", "first_ends")} | {"last_len": self.e["last_len"][b], "least": min(self.e["least"][a : b + 1])}
            row |= {c: self.total(c, a, b) for c in ("n", "total", "seqs")}
            row["inside"] = self.total("inside", a, b) + self.total("new", a + 1, b)
            row["grown"] = self.total("grown", a, b) + self.total("on", a + 1, b)
            if a:
                # equal edges go with the one that is kept: behind it on the way down from the first
                # sequence to the lowest edge, before it on the way up to the last sequence
                lowest = depth[a] == depth[left[-1]]
                like = range(a, b + 1) if a in left else [a] if lowest else range(begins[at - 1] + 1, a + 1)
                row |= {"depth": depth[a], "shared": self.k["shared"][a], "side": 0 if a in left or lowest else 1}
                row["count"] = sum(int(self.k["count"][k]) for k in like if depth[k] == depth[a])
            if a == 0 or b == self.m - 1:
                at_end = 0 if a == 0 else self.m - 1
                row |= {"seq": self.e["seq"][at_end], "upto": self.e["upto"][at_end]}
            yield row


def _rows(found) -> pa.RecordBatch:
    frame = {n: [] for n in NAMES}
    for row in found:
        for n in NAMES:
            v = row.get(n)
            frame[n].append(None if v is None or (not isinstance(v, list | bytes | str | np.ndarray) and pd.isna(v)) else v)
    return pa.RecordBatch.from_arrays([pa.array(frame[n], k) for n, k in zip(NAMES, _KINDS, strict=True)], names=NAMES)


_ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
_KINDS = [_ARROW[c.split()[1]] for c in ROWS.split(", ")]


def _joined(columns: dict, edges: dict) -> Range:
    made = Range(pd.DataFrame(columns), pd.DataFrame(edges))
    made.merge()
    return made


def _first(sequences: DataFrame) -> DataFrame:
    """Union-find within each range of the sorted sequences."""

    def run(batches):
        e = {c: [] for c in ("rep", "least", "n", "total", "first_total", "first_len", "first_ends", "seqs", "inside", "grown", "last_len", "own")}
        k = {c: [] for c in ("depth", "shared", "count", "side")}
        last, ends = None, {}
        for batch in batches:
            for r in batch.to_pylist():
                n = len(r["seq"]) // KEY
                shared = common(last["seq"], r["seq"]) if last else 0
                for c, v in (("rep", r["rep"]), ("least", r["rep"]), ("n", r["n"]), ("total", r["n"] * r["upto"][-1]), ("first_total", r["upto"][-1]), ("first_len", n), ("first_ends", r["ends"]), ("seqs", 1), ("inside", 0), ("grown", 0), ("last_len", n), ("own", True)):
                    e[c].append(v)
                for c, v in (("depth", shared), ("shared", r["upto"][shared]), ("count", 1), ("side", None)):
                    k[c].append(v)
                last = r
                ends.setdefault("first", r)
        if last is None:
            return
        m = len(e["rep"])
        e |= {c: [None] * m for c in ("seq", "upto")}
        for at, r in ((0, ends["first"]), (m - 1, last)):
            e["seq"][at], e["upto"][at] = r["seq"], r["upto"]
        made, part = _joined(e, k), TaskContext.get().partitionId()
        yield _rows([*made.nodes(part, False), *made.contracted(part)])

    tasks = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return staged(sequences.repartitionByRange(tasks, "seq").sortWithinPartitions("seq").mapInArrow(run, ROWS), "trie")


def _next(elements: DataFrame, final: bool) -> DataFrame:
    """Union-find over the contracted rows of ``FAN`` neighbouring ranges."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(key[0])
        pdf = pdf.sort_values(["part", "at"]).reset_index(drop=True)
        e = {c: pdf[c].tolist() for c in ("rep", "least", "n", "total", "first_total", "first_len", "first_ends", "seqs", "inside", "grown", "last_len", "own", "seq", "upto")}
        k = {c: pdf[c].tolist() for c in ("depth", "shared", "count", "side", "part")}
        for i in range(1, len(pdf)):
            if k["part"][i] != k["part"][i - 1]:  # the boundary between two ranges
                depth = common(e["seq"][i - 1], e["seq"][i])
                k["depth"][i], k["shared"][i], k["count"][i], k["side"][i] = depth, int(e["upto"][i][depth]), 1, None
        k["depth"][0] = k["shared"][0] = k["count"][0] = 0
        for c in ("depth", "shared", "count"):
            k[c] = [int(x) for x in k[c]]
        made = _joined(e, k)
        return _rows([*made.nodes(part, final), *made.pointers(part, final), *([] if final else made.contracted(part))]).to_pandas()

    return staged(elements.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInPandas(run, ROWS), "trie")


def branching(sequences: DataFrame) -> DataFrame:
    """(rep, least, n, total, node_depth, top, kids, leaves, weight, first_ends, parent): the branching nodes."""
    levels = [_first(sequences)]
    ranges = 1 + (levels[0].agg(F.max("part")).first()[0] or 0)
    while True:
        final = ranges <= FAN
        levels.append(_next(levels[-1].where("kind = 'element'"), final))
        if final:
            break
        ranges = -(-ranges // FAN)
    known, out = None, []
    for level in reversed(levels):
        columns = ["rep", "least", "n", "total", "node_depth", "top", "kids", "leaves", "weight", "first_ends"]
        out.append(_with_parents(level.where("kind = 'node'"), known).select(*columns, "parent"))
        told = level.where("kind = 'pointer'")
        known = cut(_with_parents(told, known).select(F.col("part").alias("up_part"), F.col("side").alias("up_side"), F.col("depth").alias("up_depth"), F.col("parent").alias("known")).distinct())
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _with_parents(rows: DataFrame, known: DataFrame | None) -> DataFrame:
    if known is None:
        return rows
    return rows.join(known, ["up_part", "up_side", "up_depth"], "left").withColumn("parent", F.coalesce("parent", "known"))


def nodes(rows: DataFrame) -> DataFrame:
    """One row per node from (id, turns): ``conv_id`` (least member), ``depth``, ``parent_conv_id``,
    ``n_convs``, ``n_children``, ``n_leaves``, ``saved_bytes`` (over its subtree, the bytes of each
    node's last turn for every member but one) and ``ends_sha256``."""
    sequences = distinct_sequences(rows)
    found = branching(sequences).join(sequences.select("rep", "upto"), "rep")
    unfolded = found.select("*", F.explode(F.sequence("top", "node_depth")).alias("depth"))
    here: Column = F.col("depth") == F.col("node_depth")
    before = F.get("upto", F.greatest(F.col("depth") - 1, F.lit(0)).cast("int"))
    return unfolded.select(
        F.col("least").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("top"), F.col("least")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(here, F.col("kids")).otherwise(F.lit(1)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("total") - F.col("weight") - (F.col("n") - 1) * before).alias("saved_bytes"),
        F.coalesce(F.when(here, F.col("first_ends")), F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def spliced(rows: DataFrame, group: int = 5, most: int = 8) -> DataFrame:
    """(id, turns): each conversation behind the beginning of its group's first one, h = crc32(id) mod
    (most + 1) turns of it: those turns, then the conversation's own after its first h."""
    h = (F.crc32(F.col("id").cast("string")) % (most + 1)).cast("int")
    heads = rows.select(F.col("id").alias("base"), F.slice("turns", 1, most).alias("head"))
    asked = rows.select("id", "turns", h.alias("h"), (F.col("id") - F.col("id") % group).alias("base")).join(heads, "base", "left")
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h")))
    return asked.select("id", F.when(head.isNull(), rest).otherwise(F.concat(head, rest)).alias("turns"))
