"""What the operators of this subpackage share: reading, staging and wide-row helpers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.storage import cut, new_path, shared_dir

__all__ = ["cut", "field", "remove", "rows_of", "shared_dir", "slices", "staged", "table", "unicode_text", "whole_row"]

#: Rows of an input batch are handed to Python code in slices of at most so many text bytes.
SLICE_BYTES = 4 << 20


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed parquet table in the shared folder and read it back, so that
    several readers each take only the columns they need."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of an intermediate table that nothing reads any more."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Split batches by the bytes of ``column``, keeping the order; a single long text stays whole."""
    for batch in batches:
        if batch.nbytes <= most:
            yield batch
            continue
        start, held = 0, 0
        for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
            n = n or 0
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        yield batch.slice(start)


def field(name: str) -> Column:
    """A column by its plain name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def unicode_text(column: str = "text") -> Column:
    return F.coalesce(field(column), F.lit(""))


def whole_row(docs: DataFrame):
    """The input row as one column, so that its names clash with nothing."""
    return F.struct(*[field(c) for c in docs.columns]).alias("row")


def rows_of(df: DataFrame, docs: DataFrame) -> DataFrame:
    """The input rows that ``df`` still carries, with the columns of ``docs``."""
    return df.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
