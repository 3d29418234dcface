"""S operators (file formats) and the streaming property."""

import json
import os

from pyspark.sql import functions as F

from conftest import SF001
from kgflow.sources import files as S
from kgflow.sources.fixtures import qa_forms
from kgflow.sources.tables import Tables
from kgflow.streaming import stream as ST


def test_read_examples_array_and_jsonl(spark, tmp_path):
    ex = [{"input": "q1", "output": "( A )", "SPARQL": ["s1"]}, {"input": "q2", "output": "( B )", "SPARQL": ["s2", "s3"]}]
    p = tmp_path / "examples.json"
    p.write_text(json.dumps(ex, indent=2))
    rows = S.read_examples(spark, str(p)).orderBy("idx").collect()
    assert [(r.idx, r.input, list(r.SPARQL)) for r in rows] == [(0, "q1", ["s1"]), (1, "q2", ["s2", "s3"])]
    jl = tmp_path / "ex.jsonl"
    jl.write_text("\n".join(json.dumps({"idx": i, **e}) for i, e in enumerate(ex)))
    assert S.read_examples(spark, str(jl), fmt="jsonl").count() == 2


def test_predictions_csv_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(0, "q, one", "['( A\n )']"), (1, 'q "2"', "x")], "idx long, question string, Llama_pred string")
    out = str(tmp_path / "pred")
    S.write_results(df, out)
    back = S.read_predictions(spark, out).orderBy("idx").collect()
    assert [(r.idx, r.question, r.Llama_pred) for r in back] == [(0, "q, one", "['( A\n )']"), (1, 'q "2"', "x")]


def test_write_results_arrays_as_json(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"])], "idx long, golds array<string>")
    out = str(tmp_path / "tsv")
    S.write_results(df, out, sep="\t")
    txt = "".join(open(os.path.join(out, f)).read() for f in os.listdir(out) if f.endswith(".csv"))
    assert '["a","b"]' in txt.replace('""', '"')


def test_contexts_and_index(spark, tmp_path):
    p = tmp_path / "ctx.jsonl"
    p.write_text(json.dumps({"idx": 0, "input": "q", "output": "f", "ent_type_dict": {"a": "def a"}}))
    r = S.read_contexts(spark, str(p)).first()
    assert r.contexts == {"a": "def a"}
    v = spark.createDataFrame([("Document", 0, 0, [1.0, 0.0])], "class string, row_id long, cluster_id long, embedding array<float>")
    a = spark.createDataFrame([("Document", 0, "tax card")], "class string, cluster_id long, alias string")
    S.write_entity_index(v, a, str(tmp_path / "idx"))
    vv, aa = S.load_entity_index(spark, str(tmp_path / "idx"))
    assert vv.count() == 1 and aa.first().alias == "tax card"


def test_streaming_equals_batch(spark, tmp_path):
    f = qa_forms(Tables(spark, SF001)).select(F.lit("r1").alias("run"), "idx", "gold", "raw_pred")
    src = str(tmp_path / "src")
    f.repartition(4).write.parquet(src)
    q = ST.start(ST.match_rates_stream(ST.clean_stream(ST.read_raw_stream(spark, src, max_files_per_trigger=1))),
                 "rates_test", checkpoint=str(tmp_path / "ckpt"))
    try:
        q.processAllAvailable()
        got = spark.sql("select * from rates_test").first()
    finally:
        q.stop()
    batch = ST.match_rates_stream(ST.clean_stream(spark.read.parquet(src))).first()
    assert (got.n, got.exact, got.skeleton, got.relation) == (batch.n, batch.exact, batch.skeleton, batch.relation)


def test_arrays_number_on_over_files_and_fail_when_broken(spark, tmp_path):
    import pytest
    for name, n in (("a.json", 2), ("b.json", 3), ("c.json", 0)):
        (tmp_path / name).write_text(json.dumps([{"input": f"{name}{i}", "output": "o", "SPARQL": []} for i in range(n)]))
    rows = S.read_examples(spark, str(tmp_path)).orderBy("idx").collect()
    assert [(r.idx, r.input) for r in rows] == [(0, "a.json0"), (1, "a.json1"), (2, "b.json0"), (3, "b.json1"), (4, "b.json2")]
    (tmp_path / "d.json").write_text("[{")
    with pytest.raises(Exception):
        S.read_examples(spark, str(tmp_path)).collect()


def test_contexts_as_array_and_tsv(spark, tmp_path):
    ex = [{"input": "q", "output": "o", "ent_type_dict": {"m": "d"}}, {"input": "r", "output": "p", "ent_type_dict": {}}]
    (tmp_path / "x.json").write_text(json.dumps(ex))
    rows = S.read_contexts(spark, str(tmp_path / "x.json"), fmt="array").orderBy("idx").collect()
    assert [(r.idx, r.input, r.contexts) for r in rows] == [(0, "q", {"m": "d"}), (1, "r", {})]
    import pandas as pd
    pd.DataFrame({"question": ["q, 1", "r"], "class_pred": [json.dumps({"m": "d"}), "{}"]}).to_csv(tmp_path / "x.tsv", sep="\t")
    rows = S.read_contexts(spark, str(tmp_path / "x.tsv"), fmt="tsv").orderBy("idx").collect()
    assert [(r.idx, r.question, r.contexts) for r in rows] == [(0, "q, 1", {"m": "d"}), (1, "r", {})]


def test_rewritten_tables_are_read_anew(spark, tmp_path):
    from kgflow.sources.tables import forget, table
    for n in (3, 5):
        spark.range(n).withColumnRenamed("id", "r_regionkey").write.mode("overwrite").parquet(str(tmp_path / "region.parquet"))
        forget(spark, str(tmp_path))
        assert table(spark, str(tmp_path), "region").count() == n
    assert table(spark, str(tmp_path), "region") is table(spark, str(tmp_path) + "/", "region")


def test_prediction_lines_and_aliases(spark, tmp_path):
    from kgflow.sources import files
    preds = spark.createDataFrame([(0, "q, \"a\"", "['x\ny']"), (1, None, "")], files.PREDICTIONS)
    files.write_results(preds, str(tmp_path / "p"), "json")
    assert sorted(files.read_predictions(spark, str(tmp_path / "p"), fmt="jsonl").collect()) == sorted(preds.collect())
    vectors = spark.createDataFrame([("A", 0, 7, [1.0]), ("B", 1, 7, [2.0]), ("B", 2, 8, [3.0])], "class string, row_id long, cluster_id long, embedding array<float>")
    aliases = spark.createDataFrame([("A", 7, "a7"), ("B", 7, "b7"), ("B", 7, "b7 too")], "class string, cluster_id long, alias string")
    files.write_entity_index(vectors, aliases, str(tmp_path / "ix"))
    v, a = files.load_entity_index(spark, str(tmp_path / "ix"))
    assert sorted((r.row_id, r.alias or "") for r in files.with_aliases(v, a).collect()) == [(0, "a7"), (1, "b7"), (1, "b7 too"), (2, "")]
