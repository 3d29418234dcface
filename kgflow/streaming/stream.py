"""Streaming use of the stateless and additive operators.

The reference has no streaming.  The text operators (T*), prompt filling
(P1-P4) and the per-row match flags (M1-M3) are Column functions, so the same
code runs on ``readStream``; the match rates are sums, so they run as a
streaming aggregate whose state is two counters per run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kgflow.functions import forms as TF
from kgflow.functions import score as M
from kgflow.session import ensure_checkpoint_dir

RAW = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("idx", T.LongType()),
    T.StructField("gold", T.StringType()),
    T.StructField("raw_pred", T.StringType()),
])


def read_raw_stream(spark: SparkSession, path: str, schema: T.StructType = RAW,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def clean_stream(raw: DataFrame, marker: str = "assistant") -> DataFrame:
    """T1 -> T4 -> T10 -> T7 per row (stateless)."""
    pred = TF.clean_prediction(TF.after_last("raw_pred", marker))
    return raw.select("run", "idx", pred.alias("pred"), TF.gold_aliases("gold").alias("golds"),
                      TF.entities("gold").alias("mentions"))


def match_rates_stream(cleaned: DataFrame) -> DataFrame:
    """M1-M3 as a running aggregate per run."""
    return cleaned.groupBy("run").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(M.exact_hit("pred", "golds").cast("long")).alias("exact"),
        F.sum(M.skeleton_hit("pred", "golds").cast("long")).alias("skeleton"),
        F.sum(M.relation_hit("pred", "golds").cast("long")).alias("relation"))


def start(df: DataFrame, name: str, sink: str | None = None, output_mode: str | None = None,
          checkpoint: str | None = None, path: str | None = None) -> StreamingQuery:
    """Start a query with its checkpoint under the shared ``spark.checkpoint.dir``
    (exactly-once restart after an executor or driver loss).  Default: Parquet files in ``path``; without a path the
    ``memory`` sink, which holds the whole result on the driver and is refused by default on a cluster."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    if sink is None:
        sink = "parquet" if path else "memory"
        if sink == "memory" and not spark.sparkContext.master.startswith("local"):
            raise ValueError("give a path: the memory sink holds the whole result on the driver")
    w = (df.writeStream.queryName(name).outputMode(output_mode or ("complete" if sink == "memory" else "append"))
         .option("checkpointLocation", checkpoint or f"{base.rstrip('/')}/stream-{name}"))
    if sink == "memory":
        return w.format("memory").start()
    return w.format(sink).option("path", path).start()
