"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgflow.session import ensure_checkpoint_dir

#: white space of the corpus contracts: space and U+0009 to U+000D (fixed value)
WS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BATCH_KEY, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder of ``spark.checkpoint.dir`` and read it
    back: cuts the lineage so that a lost executor costs a re-read, and fixes
    the rows that two readers see.  Parquet keeps it small and gives the planner
    a true size."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """From here on Arrow batches of this session hold about ``BATCH`` of data at most, unless the session says otherwise: by rows alone a batch of
    texts has no bound in bytes, and a task holds it in the JVM, in its Python worker and once more as objects there."""
    spark.conf.set(BATCH_KEY, spark.conf.get(BATCH_KEY, BATCH))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters stay."""
    return F.translate(c, UPPER, LOWER)


def key128(c: Column) -> list[Column]:
    """Two independent 64-bit hashes (columns ``k1``, ``k2``) naming a text."""
    return [F.xxhash64(c).alias("k1"), F.xxhash64(F.lit(0x5EED), c).alias("k2")]


def text_or_empty(df: DataFrame, col: str = "text") -> Column:
    """The text column as a string, null as the empty text."""
    return F.coalesce(df[col].cast("string"), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where the frame has a column of that name."""
    have, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in have:
            n += "_"
        out.append(n)
    return out
