"""Driver tables: one Parquet file per table, read lazily.

Every query reads through here so that column pruning and predicate pushdown
reach the Parquet scan.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


#: readers of each session, which go when the session does
_READS: WeakKeyDictionary[SparkSession, dict] = WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One lazy DataFrame per (session, folder, table): the file listing and
    footer schema are read once, not once per branch that uses the table.  After a folder was rewritten, ``forget`` it."""
    if name not in TABLES:
        raise KeyError(name)
    known = _READS.setdefault(spark, {})
    key = (sf_dir.rstrip("/"), name)
    if key not in known:
        known[key] = spark.read.parquet(f"{key[0]}/{name}.parquet")
    return known[key]


def forget(spark: SparkSession, sf_dir: str | None = None) -> None:
    """Read the files of a folder (all, if none is given) anew from now on."""
    known = _READS.get(spark, {})
    for key in [k for k in known if sf_dir is None or k[0] == sf_dir.rstrip("/")]:
        del known[key]


class Tables:
    """Attribute access to the driver tables of one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return table(self.spark, self.sf_dir, name)
        raise AttributeError(name)


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a DataFrame over the cluster's cores when it arrives in
    fewer partitions than cores (a small file is one split).  Used before
    CPU-heavy per-row work; a large input already has enough splits and is
    left alone, so this costs nothing at scale."""
    try:
        n = df.sparkSession.sparkContext.defaultParallelism
        have = df.rdd.getNumPartitions()
    except Exception:      # no RDD view (e.g. a remote session): leave as is
        return df
    return df.repartition(n) if have < n else df
