"""Tables -> RDF-style triples ``(s, p, o, o_kind, o_datatype, o_lang)``.

The reference ships no knowledge graph; every clause it emits reads a triple
``?s ns:p ?o``.  ``to_triples`` maps the columns of any DataFrame onto
predicates.  The default ``layout='union'`` keeps one branch per predicate
with the predicate as a literal, so a later ``filter(p == r)`` is folded by
Catalyst and only the branches (and Parquet columns) of ``r`` are scanned:
partition pruning without a materialised copy.  ``layout='explode'`` scans
the source once for all predicates and is the layout to use when writing the
triples at rest (``write_triples``: Parquet partitioned by ``p``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLE_COLUMNS = ("s", "p", "o", "o_kind", "o_datatype", "o_lang")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass
class Attr:
    """One predicate produced from a row: ``subject p object``.

    ``kind`` is ``iri`` or ``literal``.  ``datatype`` is the short XSD name
    (``integer``, ``float``, ``date``, ``dateTime``) or ``''``.  ``lang`` is a
    literal tag or a Column.  ``unique=True`` declares that the mapping cannot
    produce the same triple twice (subject is a key), which skips the
    de-duplicating shuffle for that branch.
    """

    p: str
    o: object
    kind: str = "iri"
    datatype: str = ""
    lang: object = ""
    unique: bool = False


def _branch(df: DataFrame, subject, a: Attr) -> DataFrame:
    lang = F.lit(a.lang) if isinstance(a.lang, str) else a.lang
    out = df.select(
        _col(subject).cast("string").alias("s"),
        F.lit(a.p).alias("p"),
        _col(a.o).cast("string").alias("o"),
        F.lit(a.kind).alias("o_kind"),
        F.lit(a.datatype).alias("o_datatype"),
        lang.cast("string").alias("o_lang"),
    ).filter(F.col("s").isNotNull() & F.col("o").isNotNull())
    return out if a.unique else out.distinct()


def to_triples(df: DataFrame, subject, attrs: list[Attr], layout: str = "union") -> DataFrame:
    """Map the rows of ``df`` to triples, one per (row, attribute)."""
    if layout == "union":
        return reduce(DataFrame.unionByName, [_branch(df, subject, a) for a in attrs])
    if layout == "explode":
        items = [F.struct(F.lit(a.p).alias("p"), _col(a.o).cast("string").alias("o"),
                          F.lit(a.kind).alias("o_kind"), F.lit(a.datatype).alias("o_datatype"),
                          (F.lit(a.lang) if isinstance(a.lang, str) else a.lang).cast("string").alias("o_lang"))
                 for a in attrs]
        out = (df.select(_col(subject).cast("string").alias("s"), F.explode(F.array(*items)).alias("t"))
               .select("s", "t.*").filter(F.col("s").isNotNull() & F.col("o").isNotNull()))
        return out if all(a.unique for a in attrs) else out.distinct()
    raise ValueError(layout)


def union_triples(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(*TRIPLE_COLUMNS) for p in parts])


def write_triples(triples: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write triples at rest: one Parquet folder per predicate, rows sorted by ``s``
    inside each file so row-group statistics prune subject lookups too.  Tasks hold
    ranges of ``(p, s)``: a large predicate is spread over many tasks, small ones share
    one, and there are at most tasks + predicates files, each with its own range of ``s``."""
    (triples.repartitionByRange("p", "s").sortWithinPartitions("p", "s")
     .write.mode(mode).partitionBy("p").parquet(path))


def read_triples(spark, path: str) -> DataFrame:
    """Triples at rest (``write_triples``): ``filter(p == r)`` becomes a
    partition filter, ``s`` lookups use row-group statistics."""
    return spark.read.parquet(path)


PART, PART_PREFIX, OTHER = "part", "p_", "other"
LAYOUT = "s string, p string, o string, o_kind string, o_datatype string, o_lang string, part string"


def partition_of(p: Column) -> Column:
    """Partition of a predicate that has one of its own."""
    return F.concat(F.lit(PART_PREFIX), p)


def write_layouts(triples: DataFrame, path: str, tail_rows: int = 100_000, mode: str = "overwrite", **options) -> None:
    """Two copies at rest, ``by_s`` sorted by ``(p, s)`` and ``by_o`` sorted by ``(p, o)``, so that subject and object lookups both
    skip row groups by their statistics.  A predicate with fewer than ``tail_rows`` triples goes to the partition ``other``, so a long tail of rare
    predicates makes no small files; the others have a partition each.  Tasks hold ranges, so a large predicate is many files."""
    large = triples.groupBy("p").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= tail_rows).select(F.col("p").alias("_p"))
    rows = (triples.select(*TRIPLE_COLUMNS).join(large, F.col("p") == F.col("_p"), "left")
            .select(*TRIPLE_COLUMNS, F.when(F.col("_p").isNotNull(), partition_of(F.col("p"))).otherwise(F.lit(OTHER)).alias(PART)))
    for by in ("s", "o"):
        (rows.repartitionByRange(PART, "p", by).sortWithinPartitions(PART, "p", by)
         .write.mode(mode).options(**options).partitionBy(PART).parquet(f"{path}/by_{by}"))


def read_layout(spark, path: str, by: str) -> DataFrame:
    """One copy of ``write_layouts``, with its partition column."""
    return spark.read.schema(LAYOUT).parquet(f"{path}/by_{by}")
