"""K operators: semantics checks and plan shape."""

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from kgflow.operators.graph import KG, end_property, normalise_literal, with_inverses
from kgflow.sources.fixtures import kg_triples
from kgflow.sources.tables import Tables


@pytest.fixture(scope="module")
def kg(spark):
    return KG(kg_triples(Tables(spark, SF001)))


def _triples(spark, rows):
    return KG(spark.createDataFrame(
        [(s, p, o, k, d, "") for s, p, o, k, d in rows],
        "s string, p string, o string, o_kind string, o_datatype string, o_lang string"))


def test_end_property():
    assert end_property("a.b.from") == ("a.b.from", "a.b.to")
    assert end_property("x.end_date") == ("x.start_date", "x.end_date")
    assert end_property("x.start_date") == ("x.start_date", "x.end_date")
    assert end_property("x.from_date") == ("x.from_date", "x.to_date")
    assert normalise_literal("2015", "xsd:gYear") == "2015-08:00"
    assert normalise_literal("5", "http://www.w3.org/2001/XMLSchema#integer") == "5"


def test_valid_during_open_intervals(spark):
    rows = [("a", "t", "x", "iri", ""), ("b", "t", "x", "iri", ""), ("c", "t", "x", "iri", ""),
            ("d", "t", "x", "iri", ""), ("e", "t", "x", "iri", ""),
            ("b", "v.from", "1999-01-01", "literal", "date"),           # starts after 1998
            ("c", "v.to", "1997-05-01", "literal", "date"),             # ended before 1998
            ("d", "v.from", "1990-01-01", "literal", "date"), ("d", "v.to", "2000-01-01", "literal", "date"),
            ("e", "v.from", "not a date", "literal", "date")]         # present but unusable
    g = _triples(spark, rows)
    got = {r.x for r in g.having("t", "x").valid_during("v.from", 1998).answer().collect()}
    assert got == {"a", "d"}


def test_intersect_commutes(kg):
    a = kg.having("in_nation", "nat_3").step_in("placed_by")
    b = kg.having_text("status", "F")
    assert set(a.intersect_on_x(b).answer().collect()) == set(b.intersect_on_x(a).answer().collect())


def test_inverse_step_equals_reverse_step(spark, kg):
    inv = spark.createDataFrame([("placed_by", "places")], "p string, p_inv string")
    kg2 = KG(with_inverses(kg.triples, inv))
    one = {r.x for r in kg2.having("in_nation", "nat_3").step_out("places").answer().collect()}
    two = {r.x for r in kg.having("in_nation", "nat_3").step_in("placed_by").answer().collect()}
    assert one == two and one


def test_exclude_intermediates(spark):
    g = _triples(spark, [("a", "r", "a", "iri", ""), ("b", "r", "a", "iri", "")])
    got = {r.x for r in g.of("r", "b").step_in("r").exclude_intermediates().answer().collect()}
    assert got == {"b"}          # 'a r a' makes x equal to the intermediate


def test_argmax_numeric_and_tie(spark):
    g = _triples(spark, [("a", "n", "9", "literal", "integer"), ("b", "n", "10", "literal", "integer"),
                         ("c", "n", "10", "literal", "integer"), ("a", "t", "x", "iri", ""),
                         ("b", "t", "x", "iri", ""), ("c", "t", "x", "iri", "")])
    r = g.having("t", "x").argmax("n").answer().collect()
    assert [x.x for x in r] == ["b"]            # numeric order, tie -> smallest x
    assert [x.x for x in g.having("t", "x").argmin("n").answer().collect()] == ["a"]


def test_match_refuses_products(kg):
    with pytest.raises(ValueError):
        kg.match([("?a", "in_region", "?b"), ("?c", "placed_by", "?d")])


def test_plan_prunes_predicates_and_no_cartesian(kg):
    df = kg.having("in_region", "reg_1").step_in("in_nation").step_in("placed_by").exclude_intermediates().answer()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # only the three predicate branches are scanned: nation, customer+supplier, orders
    assert "lineitem" not in plan and "part.parquet" not in plan


def test_lang_filter(spark):
    df = spark.createDataFrame([("p1", "label", "a", "literal", "", "en"), ("p2", "label", "b", "literal", "", "en-GB"),
                                ("p3", "label", "c", "literal", "", "fi"), ("p4", "label", "d", "literal", "", "")],
                               "s string, p string, o string, o_kind string, o_datatype string, o_lang string")
    g = KG(df)
    got = set()
    for s in ["p1", "p2", "p3", "p4"]:
        got |= {r.x for r in g.of("label", s).lang("en").answer().collect()}
    assert got == {"a", "b", "d"}


def test_triples_at_rest_partition_pruning(spark, tmp_path):
    from kgflow.sources.fixtures import kg_sources
    from kgflow.sources.triples import read_triples, write_triples
    lazy = KG(sources=kg_sources(Tables(spark, SF001)), spark=spark)
    path = str(tmp_path / "triples")
    write_triples(lazy.triples, path)
    files = sum(1 for _ in (tmp_path / "triples").glob("p=*/*.parquet"))
    preds = sum(1 for _ in (tmp_path / "triples").glob("p=*"))
    assert files <= int(spark.conf.get("spark.sql.shuffle.partitions")) + preds
    assert read_triples(spark, path).count() == lazy.triples.count()
    rest = KG(read_triples(spark, path))
    q = lambda g: {r.x for r in g.having("in_region", "reg_1").step_in("in_nation").step_in("placed_by")
                   .exclude_intermediates().answer().collect()}
    assert q(rest) == q(lazy) and q(rest)
    plan = rest.T("placed_by")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan and "placed_by" in plan


def test_answer_paths_mixed_directions_and_lengths(spark):
    rows = [("a", "r", "b"), ("b", "r", "c"), ("c", "q", "d"), ("e", "q", "c"), ("b", "q", "f")]
    g = _triples(spark, [(s, p, o, "iri", "") for s, p, o in rows])
    seeds = spark.createDataFrame([(1, "a"), (2, "d"), (3, "b"), (4, "z")], "query_id long, x string")
    steps = spark.createDataFrame(
        [(1, 1, "r", False), (1, 2, "r", False), (1, 3, "q", False),       # a -r-> b -r-> c -q-> d
         (2, 1, "q", True), (2, 2, "r", True),                             # d <-q- c <-r- b
         (3, 1, "q", False),                                               # b -q-> f (one step only)
         (4, 1, "r", False)],                                              # z has no edges: no answer
        "query_id long, step int, p string, inverse boolean")
    got = {(r.query_id, r.x) for r in g.answer_paths(seeds, steps, 3).collect()}
    assert got == {(1, "d"), (2, "b"), (3, "f")}


def test_bare_types():
    from kgflow.operators.graph import normalise_literal, short_datatype
    assert [short_datatype(t) for t in ("http://x#gYear", "xsd:date", "date", "gYear", None)] == ["gYear", "date", "date", "dateTime", ""]
    assert normalise_literal("1999", "gYear") == "1999" and normalise_literal("1999", "xsd:gYear") == "1999-08:00"


def test_integer_bound_keeps_decimals_and_literals_are_not_nodes(spark):
    from kgflow.operators.graph import KG, TRIPLE_SCHEMA
    rows = [(f"s{i}", "w", v, "literal", "decimal", "") for i, v in enumerate(["9.9", "12.5", "13", "99.9"])]
    rows += [("a", "r", "n7", "iri", None, None), ("b", "r", "n7", "literal", "string", "")]
    g = KG(spark.createDataFrame(rows, TRIPLE_SCHEMA))
    assert {r.x for r in g.compare("w", "ge", 10).answer().collect()} == {"s1", "s2", "s3"}
    assert {r.x for r in g.having("r", "n7").answer().collect()} == {"a"}


def test_answer_paths_steps_with_gaps_and_without_steps(spark):
    g = _triples(spark, [("a", "r", "b", "iri", ""), ("b", "r", "c", "iri", "")])
    seeds = spark.createDataFrame([(1, "a"), (2, "q")], "query_id long, x string")
    steps = spark.createDataFrame([(1, 1, "r", False), (1, 5, "r", False)], "query_id long, step int, p string, inverse boolean")
    assert {(r.query_id, r.x) for r in g.answer_paths(seeds, steps).collect()} == {(1, "c"), (2, "q")}


def test_constant_patterns_are_tests(spark):
    g = _triples(spark, [("a", "r", "b", "iri", ""), ("b", "q", "c", "iri", "")])
    for pats in ([("?x", "r", "b"), ("b", "q", "c")], [("b", "q", "c"), ("?x", "r", "b")]):
        assert [r.x for r in g.match(pats, select=["x"], distinct=True).collect()] == ["a"]
    assert g.match([("?x", "r", "b"), ("b", "q", "z")], select=["x"]).count() == 0


def test_explicit_class(spark):
    from kgflow.operators.graph import explicit_class
    df = spark.createDataFrame([("A", "class", "B", "class"), ("A", "class", "e", "entity"), ("x", "entity", "B", "class")], "a string, ak string, b string, bk string")
    assert [r[0] for r in df.select(explicit_class("a", "ak", "b", "bk")).collect()] == ["A", "e", "B"]


def test_batched_paths_join_inner(spark):
    """A hub's edges can be split: no outer join with the edges on its right."""
    g = _triples(spark, [("a", "r", "b", "iri", "")])
    seeds = spark.createDataFrame([(1, "a")], "query_id long, x string")
    steps = spark.createDataFrame([(1, 1, "r", False), (1, 2, "r", True)], "query_id long, step int, p string, inverse boolean")
    plan = g.answer_paths(seeds, steps)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftOuter") <= plan.count("coalesce(last")       # only the join with the query ends
