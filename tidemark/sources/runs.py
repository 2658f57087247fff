"""A store of forecast runs whose readers see whole commits only.

``path/data/run=<id>`` holds the rows of a run, ``path/commits/version=<n>`` one small file that names the
run and the keys it replaces. A run writes its rows first and its commit last; the commit is a single
file that Spark moves into place, and a version that another writer has taken is an error, after which
the next number is tried. So a failed run leaves nothing that a reader sees, a repeated run replaces
exactly the keys it has rows for, and a reader that began before a commit goes on with what was there.

Keys are those of a run, not of its rows: a commit has a row for each (feature set, horizon, split,
model, instrument), whatever the number of days. Rows of a key that a later run replaces stay on disk
until ``vacuum``.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["feature_set", "horizon", "split", "model", "instrument"]
ATTEMPTS = 20


def _commits(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """(keys, run, version) of all commits up to ``version``; None if there are none."""
    try:
        found = spark.read.option("basePath", f"{path}/commits").parquet(f"{path}/commits/version=*")
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise
    return found if version is None else found.where(F.col("version") <= version)


def latest(spark: SparkSession, path: str) -> int:
    """The number of the last commit, 0 before the first."""
    found = _commits(spark, path)
    return 0 if found is None else found.agg(F.max("version")).first()[0] or 0


def commit(df: DataFrame, path: str, keys: list[str] = KEYS) -> int:
    """Write a run and commit it; the version it got. Rows of a key that the store already has are
    replaced, other keys stay as they are. A run without rows commits nothing and returns the last version."""
    spark, run = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/data/run={run}")
    held = spark.read.schema(df.schema).parquet(f"{path}/data/run={run}").select(*keys).distinct().withColumn("run", F.lit(run))
    if held.isEmpty():
        return latest(spark, path)
    for _ in range(ATTEMPTS):
        version = latest(spark, path) + 1
        try:
            held.coalesce(1).write.mode("errorifexists").parquet(f"{path}/commits/version={version}")
            return version
        except AnalysisException as error:
            if error.getCondition() != "PATH_ALREADY_EXISTS":
                raise
    raise RuntimeError(f"no commit in {ATTEMPTS} attempts: other writers were always first")


def _live(commits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, run): the last run of each key."""
    return commits.groupBy(*keys).agg(F.max_by("run", "version").alias("run"))


def read(spark: SparkSession, path: str, keys: list[str] = KEYS, version: int | None = None, **only) -> DataFrame:
    """The rows of the store as of a version (the last one if None). Keyword filters on keys choose the
    runs that are read at all. An empty store is an error."""
    commits = _commits(spark, path, version)
    if commits is None:
        raise ValueError(f"no runs in {path}")
    live = _live(commits, keys)
    for c, value in only.items():
        live = live.where(F.col(c) == value)
    runs = sorted(r["run"] for r in live.select("run").distinct().collect())  # a row a run
    if not runs:
        runs = sorted(r["run"] for r in commits.select("run").distinct().limit(1).collect())
    rows = spark.read.option("basePath", f"{path}/data").option("mergeSchema", True).parquet(*[f"{path}/data/run={r}" for r in runs])
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"l.{k}")) for k in [*keys, "run"]]
    return rows.alias("r").join(live.alias("l"), same, "left_semi").drop("run")


def vacuum(spark: SparkSession, path: str, keys: list[str] = KEYS) -> int:
    """Delete runs that no key of the last version reads, uncommitted ones included; how many. Only when
    no writer is at work and no reader needs an older version."""
    commits = _commits(spark, path)
    live = set() if commits is None else {r["run"] for r in _live(commits, keys).select("run").distinct().collect()}
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data")
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = [s.getPath() for s in store.listStatus(folder) if s.getPath().getName().removeprefix("run=") not in live] if store.exists(folder) else []
    for p in gone:
        store.delete(p, True)
    return len(gone)
