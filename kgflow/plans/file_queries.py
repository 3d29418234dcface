"""The file formats, written from driver tables to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgflow.functions import forms as T
from kgflow.plans import sql_text as S
from kgflow.plans.fixture_sql import FORMS_SQL
from kgflow.plans.link_queries import _PREFIX_CASE, entity_index
from kgflow.operators import link as E
from kgflow.session import shared_path
from kgflow.sources import files
from kgflow.sources.fixtures import qa_forms
from kgflow.sources.tables import Tables


def _examples(spark, sf):
    return qa_forms(Tables(spark, sf)).select("idx", F.col("question").alias("input"), F.col("gold").alias("output"), F.array(F.concat(F.lit("SELECT "), "question"), "gold").alias("SPARQL"))


def files_examples(spark, sf):
    """S1, one object per line: the index is the data's own."""
    path = shared_path(spark, "examples")
    files.write_results(_examples(spark, sf), path, "json")
    out = files.read_examples(spark, path, "jsonl")
    return out.select("idx", "input", "output", F.element_at("SPARQL", 1).alias("sparql"), F.size("SPARQL").cast("long").alias("n"))


SQL_EXAMPLES = f"select idx, question as input, gold as output, 'SELECT ' || question as sparql, cast(2 as bigint) as n from ({FORMS_SQL})"

PER_FILE = 500


def files_examples_array(spark, sf):
    """S1, JSON arrays: files of up to ``PER_FILE`` examples; the index counts on over the files, so it names every row once."""
    path = shared_path(spark, "examples-array")
    rows = _examples(spark, sf).select((F.col("idx") / PER_FILE).cast("long").alias("file"), F.struct("input", "output", "SPARQL").alias("e"))
    arrays = rows.groupBy("file").agg(F.to_json(F.collect_list("e")).alias("value"))
    arrays.repartition("file").write.partitionBy("file").text(path)
    out = files.read_examples(spark, path, "array")
    gaps = out.agg((F.max("idx") - F.min("idx") + 1 - F.count_distinct("idx")).alias("n")).select(F.lit("(gaps in the index)").alias("output"), "n")
    return out.groupBy("output").agg(F.count(F.lit(1)).alias("n")).unionByName(gaps)


SQL_EXAMPLES_ARRAY = f"select gold as output, count(*) as n from ({FORMS_SQL}) group by 1 union all select '(gaps in the index)', 0"


def files_predictions(spark, sf):
    """A run's predictions as CSV, with quotes, brackets and line ends in the cells, and as JSON lines: both read back the same."""
    f = qa_forms(Tables(spark, sf)).select("idx", "question", F.concat(F.lit('["'), "raw_pred", F.lit('"]\n')).alias("Llama_pred"))
    csv, lines = shared_path(spark, "predictions"), shared_path(spark, "predictions-lines")
    files.write_results(f, csv, "csv")
    files.write_results(f, lines, "json")
    a, b = files.read_predictions(spark, csv), files.read_predictions(spark, lines, fmt="jsonl")
    both = a.withColumn("fmt", F.lit("csv")).unionByName(b.withColumn("fmt", F.lit("jsonl")))
    return both.select("fmt", "idx", "question", T.strip_wrapper(F.trim("Llama_pred", F.lit("\n"))).alias("pred"))


SQL_PREDICTIONS = f"""select fmt, idx, question, {S.strip_wrapper("('[\"' || raw_pred || '\"]')")} as pred
from ({FORMS_SQL}), (values ('csv'), ('jsonl')) as f(fmt)"""


def files_entity_index(spark, sf):
    """S3: vectors and aliases written by class and read back, aliases joined by (class, cluster): each entry's id, and its cluster's aliases."""
    ix = entity_index(spark, sf)
    path = shared_path(spark, "entity-index")
    names = E.cluster_aliases(ix.withColumn("alias", F.concat(F.lit("alias "), F.col("row_id") % 100)), "cluster_id", "alias")
    files.write_entity_index(ix, names, path)
    vectors, aliases = files.load_entity_index(spark, path)
    rows = files.with_aliases(vectors, aliases)
    return rows.groupBy("class", "row_id", "cluster_id").agg(F.count("alias").alias("n_aliases"), F.min("alias").alias("first_alias"), F.max(F.size("embedding")).cast("long").alias("dim")) \
        .select("row_id", E.kg_id("class", "cluster_id").alias("kg_id"), "n_aliases", "first_alias", "dim")


SQL_ENTITY_INDEX = f"""
with e as (select vec_id as row_id, label as class_order, vec_id // 4 as cluster_id, 'alias ' || (vec_id % 100) as alias, len(embedding) as dim from embeddings),
a as (select distinct class_order, cluster_id, alias from e)
select e.row_id, {_PREFIX_CASE.replace('case class_order', 'case e.class_order')} || '_' || e.cluster_id as kg_id, count(a.alias) as n_aliases, min(a.alias) as first_alias, cast(max(dim) as bigint) as dim
from e join a on e.class_order = a.class_order and e.cluster_id = a.cluster_id group by e.row_id, e.class_order, e.cluster_id"""


def files_contexts(spark, sf):
    """Every form with a mention -> definition map, one object per line; read back and listed."""
    f = qa_forms(Tables(spark, sf))
    pairs = F.array_distinct(F.transform(T.entities("gold"), lambda x: F.struct(x, F.concat(F.lit("about "), x))))
    d = f.select("idx", F.col("question").alias("input"), F.col("gold").alias("output"), F.map_from_entries(pairs).alias(files.CONTEXT_FIELD))
    path = shared_path(spark, "contexts")
    files.write_results(d, path, "json")
    return files.read_contexts(spark, path).select("idx", F.explode("contexts").alias("mention", "definition"))


SQL_CONTEXTS = f"""select idx, m as mention, 'about ' || m as definition
from (select idx, unnest(list_distinct({S.entities('gold')})) as m from ({FORMS_SQL}))"""


def files_results(spark, sf):
    """Results with a list column as a tab-separated table, read back as text."""
    f = qa_forms(Tables(spark, sf))
    path = shared_path(spark, "results")
    files.write_results(f.select("idx", "question", T.entities("gold").alias("mentions")), path, "csv", sep="\t")
    return (spark.read.schema("idx long, question string, mentions string").option("header", True).option("sep", "\t").option("escape", '"').csv(path))


SQL_RESULTS = f"select idx, question, cast(to_json({S.entities('gold')}) as varchar) as mentions from ({FORMS_SQL})"

QUERIES = {
    "files_examples": (files_examples, SQL_EXAMPLES),
    "files_examples_array": (files_examples_array, SQL_EXAMPLES_ARRAY),
    "files_predictions": (files_predictions, SQL_PREDICTIONS),
    "files_entity_index": (files_entity_index, SQL_ENTITY_INDEX),
    "files_contexts": (files_contexts, SQL_CONTEXTS),
    "files_results": (files_results, SQL_RESULTS),
}
