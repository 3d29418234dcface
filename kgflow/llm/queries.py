"""The registered queries of the corpus operators: thin wrappers that derive each
contract's columns from the operator's output.  ``name -> (callable, SQL or None)``."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgflow.llm import (collocations, decontam, kn_quality, langid, line_dedup, mixing, multi_index, packing, runs, sharding, simhash, token_counts,
                        url_filter)
from kgflow.llm.common import key128, read, text_or_empty


def op1_bin_packing(spark: SparkSession, sf: str) -> DataFrame:
    rows = sharding.assign_shards(read(spark, sf, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = token_counts.token_counts(read(spark, sf, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op3_multi_index(spark: SparkSession, sf: str) -> DataFrame:
    return multi_index.search(read(spark, sf, "embeddings"), F.pmod(F.col("id"), F.lit(100)) == 0)


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    rows = decontam.contaminated(read(spark, sf, "documents"), read(spark, sf, "benchmark"))
    return rows.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_covered", "n_tokens", "exact")


def op5_kneser_ney(spark: SparkSession, sf: str) -> DataFrame:
    rows = kn_quality.quality(read(spark, sf, "documents"), read(spark, sf, "labels"))
    return rows.withColumnRenamed("id", "doc_id")


def op6_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    docs = read(spark, sf, "documents")
    maps = line_dedup.keep_bitmaps(docs).select(F.col("id").alias("m"), F.col("k1").alias("m1"), F.col("k2").alias("m2"), "n_dropped", "bitmap")
    text = text_or_empty(docs)
    rows = docs.select("doc_id", *key128(text), text.alias("t"))
    rows = rows.join(maps, (F.coalesce("doc_id", F.lit(line_dedup.NO_ID)) == F.col("m")) & (F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")), "left")
    lines = (F.char_length("t") - F.char_length(F.translate("t", "\n", "")) + 1).cast("long")
    cols = [F.col("doc_id"), lines.alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped")]
    kept = rows.where("bitmap is not null").select(*cols, F.sha2(line_dedup.apply_bitmap("t", "bitmap"), 256).alias("kept_sha256"))
    return rows.where("bitmap is null").select(*cols, F.sha2("t", 256).alias("kept_sha256")).unionByName(kept)


RULES = "select * from values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') as r(host, path, verdict)"


def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = url_filter.judge_urls(read(spark, sf, "pages"), spark.sql(RULES))
    return rows.withColumnRenamed("id", "page_id")


SQL_OP7 = r"""
with u as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
p as (select page_id, regexp_extract(rest, '^([^/?#]*)', 1) as h, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
q as (select page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, path from p),
r(rh, rp, v) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
d as (select distinct host, path from q),
f as (select host, path, rh || rp as rule, v from d, r where (host = rh or suffix(host, '.' || rh)) and starts_with(path, rp)),
b as (select host, path, arg_max(rule, length(rule)) as rule, arg_max(v, length(rule)) as v from f group by all)
select q.page_id, q.host, q.path, b.rule, coalesce(b.v, 'allow') as verdict from q left join b on q.host = b.host and q.path = b.path
"""


def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    rows = mixing.mix(read(spark, sf, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


def op9_language_id(spark: SparkSession, sf: str) -> DataFrame:
    rows = langid.identify(read(spark, sf, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


def op10_simhash(spark: SparkSession, sf: str) -> DataFrame:
    rows = simhash.near_duplicates(read(spark, sf, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    return collocations.collocations(read(spark, sf, "documents"))


def op12_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(read(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


def planted(doc_id: str | None, n: int) -> np.ndarray | None:
    """The contract's planted repetitions: the numbers of the words to read."""
    h = zlib.crc32(doc_id.encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % p
    return at


def op13_periodic_runs(spark: SparkSession, sf: str) -> DataFrame:
    rows = runs.periodic_runs(read(spark, sf, "documents"), positions=planted)

    def better(best, x):                     # by length / period exactly; runs come by start, then period
        return F.when(best.isNull() | (x["length"] * best["period"] > best["length"] * x["period"]), x).otherwise(best)

    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", none, better)
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    rows = rows.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), best.alias("best"),
                       F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf)


SQL_OP6 = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
l as (select r, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from d),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (select key, max(doc_id) as top from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.*, s.key is not null and k.doc_id <> s.top as gone from k left join s on k.key = s.key)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by r
"""

QUERIES = {
    "op1_bin_packing": (op1_bin_packing, None),
    "op2_token_counts": (op2_token_counts, None),
    "op3_multi_index": (op3_multi_index, None),
    "op4_decontamination": (op4_decontamination, None),
    "op5_kneser_ney": (op5_kneser_ney, None),
    "op6_line_dedup": (op6_line_dedup, SQL_OP6),
    "op7_url_filter": (op7_url_filter, SQL_OP7),
    "op8_mixing": (op8_mixing, None),
    "op9_language_id": (op9_language_id, None),
    "op10_simhash": (op10_simhash, None),
    "op11_collocations": (op11_collocations, None),
    "op12_packing": (op12_packing, None),
    "op13_periodic_runs": (op13_periodic_runs, None),
    "pipeline": (pipeline, None),
}
