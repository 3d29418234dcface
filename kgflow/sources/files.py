"""The reference's file formats, read with explicit schemas.

Alignment between predictions and gold in the reference is positional; Spark
has no row position, so every reader returns an explicit ``idx``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXAMPLE = T.StructType([
    T.StructField("input", T.StringType()),
    T.StructField("output", T.StringType()),
    T.StructField("SPARQL", T.ArrayType(T.StringType())),
])

PREDICTIONS = T.StructType([
    T.StructField("idx", T.LongType()),
    T.StructField("question", T.StringType()),
    T.StructField("Llama_pred", T.StringType()),
])

CONTEXT_FIELD = "ent_type_dict"


def _array_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Objects of one JSON array per file with an ``idx`` that counts on over the files in the order of
    their names.  A file that is not such an array fails the job."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.from_json(
        "value", T.ArrayType(schema), {"mode": "FAILFAST"}).alias("a"))
    sizes = raw.select("file", F.size("a").alias("n"))
    before = sizes.select("file", (F.coalesce(F.sum("n").over(Window.orderBy("file")), F.lit(0)) - F.col("n")).alias("before"))   # one row per file
    rows = raw.join(F.broadcast(before), "file").select("before", F.posexplode("a").alias("pos", "e"))
    return rows.select((F.col("before") + F.col("pos")).cast("long").alias("idx"), "e.*")


def read_examples(spark: SparkSession, path: str, fmt: str = "array") -> DataFrame:
    """QA examples with a stable index.

    ``fmt='array'``: the reference's single JSON array per file, read whole
    (``wholetext``) and exploded with its position -- fine for the small
    example sets it ships.  ``fmt='jsonl'``: one object per line, split across
    tasks; ``idx`` then comes from an ``idx`` field in the data."""
    if fmt == "array":
        return _array_rows(spark, path, EXAMPLE)
    if fmt == "jsonl":
        schema = T.StructType([T.StructField("idx", T.LongType())] + EXAMPLE.fields)
        return spark.read.schema(schema).json(path)
    raise ValueError(fmt)


def read_predictions(spark: SparkSession, path: str, schema: T.StructType = PREDICTIONS, fmt: str = "csv") -> DataFrame:
    """Predictions.  ``fmt='csv'``: the reference's CSV (pandas index as first column, quoted cells that may span lines).  Spark cannot
    split such a file: one task reads it, at some 50 MB a second, so keep files below 1 GB (a folder of many files reads in parallel).
    ``fmt='jsonl'``: one object per line, as ``write_results(..., fmt="json")`` makes it, split at any line: the form for large runs."""
    if fmt == "jsonl":
        return spark.read.schema(schema).json(path)
    if fmt != "csv":
        raise ValueError(fmt)
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


VECTORS = "row_id long, cluster_id long, embedding array<float>, class string"
ALIASES = "cluster_id long, alias string, class string"


def load_entity_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S3: the entity index at rest -- ``vectors(class, row_id, cluster_id,
    embedding)`` and ``aliases(class, cluster_id, alias)``, Parquet partitioned
    by ``class`` (the reference opens three files per class per mention)."""
    vectors = spark.read.schema(VECTORS).parquet(f"{path}/vectors")
    aliases = spark.read.schema(ALIASES).parquet(f"{path}/aliases")
    return vectors, aliases


def with_aliases(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """``rows`` (with ``class`` and ``cluster_id``, such as linked mentions or the vectors) with a row per alias of their cluster; cluster ids count
    per class, so both join.  A cluster without aliases keeps one row with a null."""
    names = aliases.select(F.col("class").alias("_class"), F.col("cluster_id").alias("_cluster"), "alias")
    return rows.join(names, (F.col("class") == F.col("_class")) & (F.col("cluster_id") == F.col("_cluster")), "left").drop("_class", "_cluster")


def write_entity_index(vectors: DataFrame, aliases: DataFrame, path: str, mode: str = "overwrite") -> None:
    for df, schema, name in ((vectors, VECTORS, "vectors"), (aliases, ALIASES, "aliases")):
        typed = [F.col(c).cast(t).alias(c) for c, t in (f.split() for f in schema.split(", "))]
        df.select(*typed).write.mode(mode).partitionBy("class").parquet(f"{path}/{name}")


def read_contexts(spark: SparkSession, path: str, field: str = CONTEXT_FIELD, fmt: str = "jsonl") -> DataFrame:
    """Augmented contexts with a mention -> definition map ``contexts``.  ``fmt='jsonl'``: one object per
    line with its ``idx``; ``'array'``: one JSON array per file, numbered; ``'tsv'``: a tab-separated table
    whose first column is the index and whose ``class_pred`` is the map as JSON text."""
    entry = T.StructType([T.StructField("input", T.StringType()), T.StructField("output", T.StringType()),
                          T.StructField(field, T.MapType(T.StringType(), T.StringType()))])
    if fmt == "array":
        return _array_rows(spark, path, entry).withColumnRenamed(field, "contexts")
    if fmt == "tsv":
        rows = spark.read.option("header", True).option("sep", "\t").option("multiLine", True).option("escape", '"').csv(path)
        return rows.withColumnsRenamed({rows.columns[0]: "idx"}).withColumns({
            "idx": F.col("idx").cast("long"), "contexts": F.from_json("class_pred", T.MapType(T.StringType(), T.StringType()))}).drop("class_pred")
    if fmt != "jsonl":
        raise ValueError(fmt)
    schema = T.StructType([T.StructField("idx", T.LongType()), *entry.fields])
    return spark.read.schema(schema).json(path).withColumnRenamed(field, "contexts")


def write_results(df: DataFrame, path: str, fmt: str = "csv", sep: str = ",", mode: str = "overwrite") -> None:
    """CSV / TSV / JSON lines.  CSV cannot hold arrays or maps, so those
    columns are written as JSON text."""
    if fmt == "json":
        df.write.mode(mode).json(path)
        return
    out = df.select(*[F.to_json(F.col(f.name)).alias(f.name)
                      if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f.name)
                      for f in df.schema.fields])
    out.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)
