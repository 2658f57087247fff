"""Merkle fixity audit of WARC archives and their replicas.

An archive is a set of files of records, each with its offsets. A leaf hashes a record's place, its
offset range and its digest; a node hashes the places and hashes of its up to ``FANOUT`` children, so
a child that is lost, added or swapped with its neighbour changes it. A file's nodes cover ordered
ranges of its records and so of its offsets. File roots are leaves of a second tree, in which a
file's place follows from its name: a file that one replica lacks moves no other.

Both replicas have a manifest of their own, of any length. Their roots are compared, then only the
children of nodes that differ, down to the leaves. What differs there is matched by record: a record
is ``missing`` or ``extra`` in the replica, ``altered``, or ``moved`` (unharmed, but at another place
or offset).

Levels are written once per replica (each is ``FANOUT`` times smaller than the one below) and joins
go by node. Running offsets are summed by segments of ``SEGMENT`` records, so no window holds more
than a segment's records or a file's segments.

A null url or body counts as empty, a null id is written as an empty id, a null file name is a file
of its own; repeated records are records of their own. Only the id, url and body columns are read,
and the file expression. An archive without records has no tree; audited against another, all
records of that are missing or extra, against an empty one nothing is found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import cut, field, unicode_text
from tidemark.llm.sharding import numbered

FANOUT = 16
#: Records of a file where no other layout is given.
FILE_RECORDS = 1024
SEGMENT = 1024


def record(id_col: Column, url: Column, body: Column) -> Column:
    """The bytes of a resource record, as text."""
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"),
        F.coalesce(id_col.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "),
        url,
        F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"),
        F.lit("\r\n\r\n"),
        body,
        F.lit("\r\n\r\n"),
    )


def manifest(pages: DataFrame, file: Column | None = None, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """One row per record: ``file`` (text; by running number, ``FILE_RECORDS`` each, where none is
    given), ``nth`` (place in the file, from 0), ``start`` and ``end`` (offsets in the file), the id
    and ``digest``. Records of a file are in the order of id, url and digest."""
    url, body = unicode_text(url_col), unicode_text(body_col)
    own = record(field(id_col), url, body)
    name = F.lit("") if file is None else F.coalesce(file.cast("string"), F.lit("\0null"))
    listed = pages.select(name.alias("file"), field(id_col).alias("id"), url.alias("url"), F.sha2(own, 256).alias("digest"), F.octet_length(own).cast("long").alias("size"))
    rows, _ = numbered(listed, ["file", "id", "url", "digest"])
    if file is None:
        rows = rows.withColumn("file", F.floor(F.col("row_number") / FILE_RECORDS).cast("string"))
    first = rows.groupBy("file").agg(F.min("row_number").alias("first"))
    rows = rows.join(first, "file").withColumn("nth", F.col("row_number") - F.col("first"))
    rows = rows.withColumn("segment", F.floor(F.col("nth") / SEGMENT).cast("long"))
    earlier = Window.partitionBy("file").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = rows.groupBy("file", "segment").agg(F.sum("size").alias("bytes"))
    segments = segments.select("file", "segment", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("file", "segment").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("before") + F.sum("size").over(within)
    return rows.join(segments, ["file", "segment"]).withColumn("end", end).select("file", "nth", (F.col("end") - F.col("size")).alias("start"), "end", F.col("id").alias(id_col), "digest")


def shape(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> tuple[int, int]:
    """Levels that the longest file needs, and levels over the files, of both replicas."""
    row = left.union(right).agg(F.max("nth").alias("nth"), F.count_distinct("file").alias("files")).first()
    levels = lambda n: next(k for k in range(64) if fanout**k >= n)
    return levels((row["nth"] or 0) + 1), levels(row["files"] or 1)


def _parents(level: DataFrame, file: Column, node: Column, child: Column) -> DataFrame:
    """Nodes over (file, node): each hashes its children's places and hashes, in order."""
    children = F.sort_array(F.collect_list(F.struct(child.alias("at"), F.col("hash"))))  # at most `fanout`, or a bucket's files
    told = F.transform("children", lambda c: F.concat(c["at"].cast("string"), F.lit(":"), c["hash"]))
    rows = level.groupBy(file.alias("file"), node.cast("long").alias("node")).agg(children.alias("children"))
    return cut(rows.select("file", "node", F.sha2(F.array_join(told, "\n"), 256).alias("hash")))


def tree(leaves: DataFrame, heights: tuple[int, int], fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of (file, node, hash) from the records up to the root. A record's node is its place in
    the file; above the file roots ``file`` is empty and a node is a bucket of files."""
    told = F.concat_ws(":", "nth", "start", "end", F.coalesce("digest", F.lit("")))
    levels = [cut(leaves.select("file", F.col("nth").alias("node"), F.sha2(told, 256).alias("hash")))]
    inside, over = heights
    for _ in range(inside):
        levels.append(_parents(levels[-1], F.col("file"), F.floor(F.col("node") / fanout), F.col("node")))
    levels.append(_parents(levels[-1], F.lit(""), _bucket(over, fanout), F.col("file")))
    for _ in range(over):
        levels.append(_parents(levels[-1], F.lit(""), F.floor(F.col("node") / fanout), F.col("node")))
    return levels


def _bucket(over: int, fanout: int) -> Column:
    return F.pmod(F.xxhash64("file"), F.lit(fanout**over))


def descend(left: list[DataFrame], right: list[DataFrame], heights: tuple[int, int], fanout: int = FANOUT) -> DataFrame:
    """(file, node) of the leaves that differ or that one side lacks; only children of nodes that
    differ are looked at."""
    differ, over = None, heights[1]
    for k in range(len(left) - 1, -1, -1):
        sides = [left[k], right[k]]
        if differ is not None:
            top = k > heights[0]  # buckets of files
            parent = _bucket(over, fanout) if k == heights[0] else F.floor(F.col("node") / fanout).cast("long")
            of = F.col("file") if k < heights[0] else F.lit("")
            wanted = differ.select(F.col("file").alias("p_file"), F.col("node").alias("p_node"))
            if top or k == heights[0]:
                wanted = wanted.where("p_file = ''")
            sides = [s.withColumns({"p_file": of, "p_node": parent}).join(wanted, ["p_file", "p_node"], "left_semi").select("file", "node", "hash") for s in sides]
        a, b = sides[0], sides[1].withColumnRenamed("hash", "other")
        differ = a.join(b, ["file", "node"], "full_outer").where(~F.col("hash").eqNullSafe(F.col("other"))).select("file", "node")
    return differ


def audit(original: DataFrame, replica: DataFrame, id_col: str = "page_id", fanout: int = FANOUT) -> DataFrame:
    """One row per record that is not the same in both manifests: file, id, ``start``, ``end`` and
    ``digest`` of the original, ``replica_start``, ``replica_end``, ``replica_digest``, ``damage``."""
    both = [cut(m.withColumnRenamed(id_col, "id")) for m in (original, replica)]
    heights = shape(*both, fanout)
    found = cut(descend(*(tree(m, heights, fanout) for m in both), heights, fanout).withColumnRenamed("node", "nth"))
    a, b = (m.join(found, ["file", "nth"], "left_semi").select("file", "id", F.struct("start", "end", "digest").alias("r"), "nth") for m in both)
    same = Window.partitionBy("file", "id", "r.digest").orderBy("nth")
    matched = _matched(a, b, same, [F.col("r.digest")])
    # what has no equal on the other side is matched by its id alone
    rest = Window.partitionBy("file", "id").orderBy("nth")
    lost, new = (cut(matched.where(f"{other} is null").select("file", "id", F.col(own).alias("r"), F.col(own).getField("start").alias("nth"))) for own, other in (("x", "y"), ("y", "x")))
    rows = matched.where("x is not null and y is not null").unionByName(_matched(lost, new, rest, []))
    damage = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(F.col("x.digest") != F.col("y.digest"), "altered").otherwise("moved")
    of = lambda side, prefix: [F.col(f"{side}.{c}").alias(prefix + c) for c in ("start", "end", "digest")]
    return rows.select("file", F.col("id").alias(id_col), *of("x", ""), *of("y", "replica_"), damage.alias("damage"))


def _matched(a: DataFrame, b: DataFrame, order, more: list[Column]) -> DataFrame:
    """(file, id, x, y): the k-th record of a kind on one side with the k-th on the other."""
    told = lambda df, name: df.select("file", "id", F.row_number().over(order).alias("k"), F.struct(*more, F.lit(0)).alias("kind"), F.col("r").alias(name))
    x, y = told(a, "x").alias("a"), told(b, "y").alias("b")
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("file", "id", "k", "kind")]
    return cut(x.join(y, on, "full_outer").select(F.coalesce("a.file", "b.file").alias("file"), F.coalesce("a.id", "b.id").alias("id"), "x", "y"))
