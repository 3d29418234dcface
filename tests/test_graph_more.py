"""Cycles, semi-join chains, two copies at rest, per-group arg max, class chains, instants in batches, term kinds."""

import itertools
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from kgflow.operators import cycles, intervals
from kgflow.operators.graph import KG, TRIPLE_SCHEMA, Lit, subtype_closure
from kgflow.plans.kg_queries import kg as fixture
from kgflow.sources.triples import read_layout, write_layouts


def _kg(spark, rows):
    return KG(spark.createDataFrame([(s, p, o, k, d, lang) for s, p, o, k, d, lang in (r if len(r) == 6 else (*r, "iri", "", "") for r in rows)], TRIPLE_SCHEMA))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _xs(b):
    return sorted(r.x for r in b.answer().collect())


# --- term kinds -----------------------------------------------------------------------
def test_literals_have_no_hops(spark):
    g = _kg(spark, [("a", "name", "b", "literal", "", "en"), ("b", "r", "c"), ("a", "knows", "b"), ("d", "name", "x y"), ("e", "name", "x y", "literal", "", None)])
    assert _xs(g.of("name", "a").step_out("r")) == [] and _xs(g.of("knows", "a").step_out("r")) == ["c"]
    seeds = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "query_id long, x string")
    steps = spark.createDataFrame([(1, 1, "name", False), (1, 2, "r", False), (2, 1, "knows", False), (2, 2, "r", False), (3, 1, "name", True), (4, 1, "name", False)],
                                  "query_id long, step int, p string, inverse boolean")
    assert sorted(map(tuple, g.answer_paths(seeds, steps).collect())) == [(2, "c"), (4, "b")]
    assert _xs(g.having_text("name", "x y")) == ["e"] and _xs(g.having("name", "x y")) == ["d"]


def test_terms_unify_by_kind(spark):
    g = _kg(spark, [("a", "p", "t"), ("b", "q", "t", "literal", "", "en"), ("c", "q", "t", "literal", "", "fi"), ("d", "p", "u", "literal", "", "en"), ("e", "q", "u", "literal", "", "en")])
    both = g.of("p", "a").intersect_on_x(g.of("q", "b"))
    assert _xs(both) == [] and both.df.columns[-1] == "x_lang"
    assert _xs(g.of("q", "b").intersect_on_x(g.of("q", "c"))) == [] and _xs(g.of("p", "d").intersect_on_x(g.of("q", "e"))) == ["u"]
    assert _xs(g.of("p", "d").semi_intersect(g.of("q", "e"))) == ["u"] and _xs(g.of("p", "a").semi_intersect(g.of("q", "b"))) == []
    pairs = sorted((r.s, r.t) for r in g.match([("?s", "p", "?x"), ("?t", "q", "?x")], select=["s", "t"]).collect())
    assert pairs == [("d", "e")]
    assert [r.s for r in g.match([("?s", "p", "t")]).collect()] == ["a"] and g.match([("?s", "q", "t")]).count() == 0
    assert [r.s for r in g.match([("?s", "q", Lit("t", "fi"))]).collect()] == ["c"]
    # an object that is a subject elsewhere must be a node
    g = _kg(spark, [("a", "p", "t", "literal", "", ""), ("t", "q", "z"), ("b", "p", "t")])
    assert [r.s for r in g.match([("?s", "p", "?x"), ("?x", "q", "?y")], select=["s"]).collect()] == ["b"]


def test_two_hop_compare_walks_nodes_only(spark):
    g = _kg(spark, [("a", "r", "m"), ("m", "v", "5", "literal", "integer", ""), ("b", "r", "m", "literal", "", ""), ("m", "w", "7", "literal", "integer", ""),
                    ("a", "r", "n"), ("n", "w", "9", "literal", "integer", "")])
    assert _xs(g.compare2("r", "v", "ge", 1)) == ["a"]
    first = g.compare2("r", "v", "ge", 5)
    assert _xs(first.compare2("r", "w", "ge", 8)) == ["a"] and _xs(first.compare2("r", "w", "ge", 8, shared_mediator="v1")) == []
    assert _xs(first.compare2("r", "w", "ge", 7, shared_mediator="v1")) == ["a"]
    with pytest.raises(ValueError):
        first.compare2("r", "w", "ge", 8, shared_mediator="v9")


# --- cycles ---------------------------------------------------------------------------
@pytest.fixture(scope="module")
def hub_graph(spark):
    rng = random.Random(2)
    pairs = {tuple(rng.sample(range(60), 2)) for _ in range(400)} | {(h, i) for h in (100, 101) for i in range(60)} | {(100, 101)}
    df = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs] + [("n1", "n1"), (None, "n1")], "u string, v string")
    near = {}
    for a, b in pairs:
        near.setdefault(f"n{a}", set()).add(f"n{b}")
        near.setdefault(f"n{b}", set()).add(f"n{a}")
    return df, near


@pytest.mark.parametrize("chunk", [4096, 4])
def test_triangles(hub_graph, chunk):
    df, near = hub_graph
    want = {frozenset((a, b, c)) for a in near for b in near[a] for c in near[a] & near[b]}
    got = [frozenset(r) for r in cycles.triangles(df, chunk).collect()]
    assert len(got) == len(want) and set(got) == want


def test_four_cycles_and_fewer_rows_than_wedges(hub_graph):
    df, near = hub_graph
    want = {frozenset((frozenset((a, c)), frozenset(bd))) for a, c in itertools.combinations(sorted(near), 2) for bd in itertools.combinations(sorted(near[a] & near[c]), 2)}
    got = [frozenset((frozenset((r.v, r.w)), frozenset((r.a, r.b)))) for r in cycles.four_cycles(df).collect()]
    assert len(got) == len(want) and set(got) == want
    wedges = sum(len(x) * (len(x) - 1) // 2 for x in near.values())
    edges = sum(map(len, near.values())) // 2
    assert cycles.two_steps(df).count() < wedges / 2
    # a triangle's rows in between are the edges (here no list is split)
    assert cycles.directed(df).count() == edges < wedges
    out = cycles.directed(df).groupBy("u").count().agg(F.max("count")).first()[0]
    assert out <= (2 * edges) ** 0.5 + 1 < max(map(len, near.values()))


def test_typed_cycles(spark):
    rng = random.Random(5)
    rel = {p: {(f"{a}{rng.randrange(12)}", f"{b}{rng.randrange(12)}") for _ in range(70)} for p, a, b in (("p", "x", "x"), ("q", "x", "x"), ("r", "x", "x"), ("t", "x", "x"))}
    g = _kg(spark, [(s, p, o) for p, es in rel.items() for s, o in es] + [("x1", "p", "x2", "literal", "", "")])
    tri = sorted((r.a, r.b, r.c) for r in cycles.match_triangle(g, [("?a", "p", "?b"), ("?b", "q", "?c"), ("?a", "r", "?c")]).collect())
    assert tri == sorted((a, b, c) for a, b in rel["p"] for b2, c in rel["q"] if b2 == b and (a, c) in rel["r"]) and tri
    four = sorted((r.a, r.b, r.c, r.d) for r in cycles.match_four_cycle(g, [("?a", "p", "?b"), ("?b", "q", "?c"), ("?d", "t", "?c"), ("?a", "r", "?d")]).collect())
    want = sorted((a, b, c, d) for a, b in rel["p"] for b2, c in rel["q"] if b2 == b for a2, d in rel["r"] if a2 == a and (d, c) in rel["t"])
    assert four == want and four
    with pytest.raises(ValueError):
        cycles.match_triangle(g, [("?a", "p", "?b"), ("?b", "q", "?c"), ("?c", "r", "?d")])


# --- semi-joins and layouts ---------------------------------------------------------------
def test_hops_without_intermediates(spark):
    g = fixture(spark, SF001)
    kept = g.having("in_region", "reg_2").step_in("in_nation").step_in("placed_by")
    semi = g.having("in_region", "reg_2").step_in("in_nation", keep=False).step_in("placed_by", keep=False)
    assert _xs(kept) == _xs(semi) and semi.df.columns == ["x", "x_lang"]
    plan = semi.df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") >= 2 and "Join Inner" not in plan
    with pytest.raises(ValueError):
        semi.exclude_intermediates()


def test_participants(spark):
    g = _kg(spark, [("b", "r", "a"), ("c", "r", "a"), ("d", "r", "b"), ("d", "v", "5", "literal", "integer", ""), ("e", "r", "z"), ("a", "t", "T"), ("z", "t", "T"), ("f", "r", "c"), ("d", "q", "lit", "literal", "", "")])
    sets = g.participants(g.having("t", "T"), ["r", "r"], g.compare("v", "ge", 5))
    assert [sorted(r.x for r in s.collect()) for s in sets] == [["a"], ["b"], ["d"]]
    sets = g.participants(g.having("t", "T"), ["r", "r", ("R", "q")])
    assert [sorted(r.x for r in s.collect()) for s in sets] == [["a"], ["b"], ["d"], ["lit"]]


def test_object_lookups_skip_row_groups(spark, tmp_path):
    """20,000 edges: a K1 constant and a K3 range are read from few of the row groups of the copy by object."""
    n = 20_000
    rows = spark.range(n).select(F.format_string("s%06d", (F.col("id") * 7919) % n).alias("s"), F.lit("r").alias("p"), F.format_string("o%06d", F.col("id")).alias("o"),
                                 F.lit("iri").alias("o_kind"), F.lit("").alias("o_datatype"), F.lit("").alias("o_lang"))
    rare = spark.range(50).select(F.concat(F.lit("x"), "id").alias("s"), F.concat(F.lit("rare"), "id").alias("p"), F.lit("o000007").alias("o"), F.lit("iri").alias("o_kind"),
                                  F.lit("").alias("o_datatype"), F.lit("").alias("o_lang"))
    hop = spark.createDataFrame([("o000100", "up", "top", "iri", "", ""), ("o000101", "up", "top", "iri", "", "")], TRIPLE_SCHEMA)
    path = str(tmp_path / "kg")
    write_layouts(rows.unionByName(rare).unionByName(hop), path, tail_rows=1000, **{"parquet.block.size": 32_768, "parquet.page.size": 4096, "parquet.block.size.row.check.min": 1})
    assert sorted(f.name for f in (tmp_path / "kg" / "by_o").iterdir() if f.is_dir()) == ["part=other", "part=p_r"]
    g = KG.at_rest(spark, path)

    one, two = g.having("r", "o000123").df, g.having("up", "top").step_in("r").df
    assert one.count() == 1 and two.count() == 2
    assert all("/by_o/" in f for f in one.inputFiles()) and "EqualTo(o,o000123)" in _plan(one) and "IN (p_r,other)" in _plan(one)
    # the least and the greatest node of the hop's start are constants of the scan
    assert all("/by_o/" in f for f in two.inputFiles()) and "GreaterThanOrEqual(o,o000100)" in _plan(two)
    assert 0 < _scans(two, "numOutputRows")[0] < n / 10
    # the same bounds on the copy by subject reach all of its row groups
    by_s = read_layout(spark, path, "s").where("part = 'p_r' and o >= 'o000100' and o <= 'o000101'").select("s", "o")
    assert _scans(by_s, "numOutputRows")[0] > n / 2


def test_paths_at_rest_read_only_their_predicates(spark, tmp_path):
    """40 predicates of their own, a batch of 20,000 entries that names one: only its partitions are read, and no list of predicates is made."""
    rows = spark.range(4000).select(F.concat(F.lit("n"), "id").alias("s"), F.concat(F.lit("p"), F.col("id") % 40).alias("p"), F.concat(F.lit("n"), F.col("id") + 1).alias("o"),
                                    F.lit("iri").alias("o_kind"), F.lit("").alias("o_datatype"), F.lit("").alias("o_lang"))
    path = str(tmp_path / "kg")
    write_layouts(rows, path, tail_rows=50)
    g = KG.at_rest(spark, path)
    seeds = spark.range(10_000).select(F.col("id").alias("query_id"), F.concat(F.lit("n"), (F.col("id") * 40 + 3) % 4000).alias("x"))
    steps = seeds.select("query_id", F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(p).alias("p"), F.lit(inv).alias("inverse")) for i, (p, inv) in
                                                         enumerate([("p3", False), ("p3", True)], 1)])).alias("e")).select("query_id", "e.*")
    out = g.answer_paths(seeds, steps)
    assert "dynamicpruning" in _plan(out)
    got = out.collect()
    assert len(got) == 10_000 and all(r.x == f"n{(r.query_id * 40 + 3) % 4000}" for r in got)
    files = _scans(out, "numFiles", "part#")
    assert files and all(n <= 4 for n in files)              # of 40 partitions in each copy: the predicate's, in a file or a few


def test_inverses_at_rest(spark, tmp_path):
    from kgflow.operators.graph import with_inverses
    rows = [(f"s{i}", f"p{i % 30}", f"o{i % 50}", "iri", "", "") for i in range(900)] + [("o1", "back", "s1", "iri", "", ""), ("x", "p1", "lit", "literal", "", "")]
    df = spark.createDataFrame(rows, TRIPLE_SCHEMA)
    write_layouts(df, str(tmp_path / "kg"), tail_rows=20)
    inverse = spark.createDataFrame([("p1", "back"), ("p1", "back2"), ("p3", "p4"), ("rare", "x")], "p string, p_inv string")
    out = with_inverses(read_layout(spark, str(tmp_path / "kg"), "s"), inverse)
    want = with_inverses(df, inverse)
    assert sorted(map(tuple, out.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    assert _plan(out).count("dynamicpruning") >= 2
    assert min(_scans(out, "numFiles", "part#")) <= 6


def _scans(df, metric, mark=""):
    """A metric of every scan whose text has ``mark``, after running ``df``; constant starts of a chain come last."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    out, todo = [], [plan]
    while todo:
        p = todo.pop(0)
        kind = p.getClass().getSimpleName()
        if kind == "FileSourceScanExec" and mark in p.toString():
            out.append(p.metrics().apply(metric).value())
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(p.plan())
        it = p.children().iterator()
        while it.hasNext():
            todo.append(it.next())
    return sorted(out, reverse=True)


# --- K15 per group --------------------------------------------------------------------------
def test_arg_per_group(spark):
    vals = [("g1", "a", "9", "integer"), ("g1", "b", "10", "integer"), ("g1", "ab", "10", "integer"), ("g2", "c", "x", ""), ("g2", "d", "3.5", "float"), ("g3", "e", "zz", ""), ("g3", "f", "aa", "")]
    g = _kg(spark, [(x, "in", grp) for grp, x, _, _ in vals] + [(x, "v", v, "literal", t, "") for _, x, v, t in vals] + [(grp, "t", "G") for grp in ("g1", "g2", "g3")])
    b = g.having("t", "G").step_in("in")
    top = {r.v1: (r.x, r.arg) for r in b.argmax_per("v1", "v").collect()}
    low = {r.v1: (r.x, r.arg) for r in b.argmin_per("v1", "v").collect()}
    assert top == {"g1": ("ab", "10"), "g2": ("d", "3.5"), "g3": ("e", "zz")}
    assert low == {"g1": ("a", "9"), "g2": ("d", "3.5"), "g3": ("f", "aa")}
    for one, per in ((b.argmax("v"), top), (b.argmin("v"), low)):
        r = one.df.first()
        assert (r.x, r[one.df.columns.index("x")]) and r.x in {x for x, _ in per.values()}
    plan = b.argmax_per("v1", "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == b.df._jdf.queryExecution().optimizedPlan().toString().count("Join") + 1        # the hop itself


def test_argmax_per_group_orders_names_of_all_lengths(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("aéZ0~ ") for _ in range(rng.randrange(1, 6))) for _ in range(200)]
    g = _kg(spark, [(x, "in", "g") for x in set(names)] + [(x, "v", "1", "literal", "integer", "") for x in set(names)] + [("g", "t", "G")])
    assert g.having("t", "G").step_in("in").argmax_per("v1", "v").first().x == min(names, key=lambda x: x.encode())


# --- K27 and K13 -------------------------------------------------------------------------------
def test_closure_with_cycles_and_long_chains(spark):
    rng = random.Random(3)
    pairs = [(f"c{i}", f"c{i + 1}") for i in range(20)] + [(f"c{rng.randrange(30)}", f"c{rng.randrange(30)}") for _ in range(25)] + [("x", "x")]
    above = {a: {b for t, b in pairs if t == a} for a, _ in pairs}
    want = set()
    for a in above:
        seen, todo = set(), [a]
        while todo:
            for b in above.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        want |= {(a, b) for b in seen if a != b}
    got = subtype_closure(spark.createDataFrame(pairs, "t string, super string")).collect()
    assert len(got) == len(want) and {(r.t, r.super) for r in got} == want
    with pytest.raises(ValueError):
        subtype_closure(spark.createDataFrame(pairs, "t string, super string"), max_rounds=2)
    assert subtype_closure(spark.createDataFrame([], "t string, super string")).count() == 0


def test_dyadic_blocks(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(500), rng.randrange(500)) for _ in range(300)] + [(0, (1 << 22) - 1), (5, 5), (7, 3), (3, -1), (1 << 22, 9)]
    for r in spark.createDataFrame(rows, "lo int, hi int").select("lo", "hi", intervals.blocks(F.col("lo"), F.col("hi")).alias("b")).collect():
        days = [d for k in r.b for d in (k.block << k.level, ((k.block + 1) << k.level) - 1)]
        if r.hi - r.lo < 1000:
            days = sorted(d for k in r.b for d in range(k.block << k.level, (k.block + 1) << k.level))
            assert days == list(range(r.lo, r.hi + 1))
        assert len(r.b) <= 44


def test_valid_at_equals_the_anti_join(spark):
    rng = random.Random(6)
    day = lambda: (date(1999, 1, 1) + timedelta(days=rng.randrange(900))).isoformat()
    rows, subjects = [], [f"s{i}" for i in range(120)]
    for s in subjects:
        for p in ("v.from", "v.to"):
            rows += [(s, p, rng.choice([day(), day(), "not a date"]), "literal", "date", "") for _ in range(rng.choice([0, 1, 1, 2]))]
    instants = [(f"q{i}", date(1999, 1, 1) + timedelta(days=rng.randrange(900))) for i in range(40)] + [("none", None), ("early", date(1, 1, 1)), ("late", date(9999, 12, 31))]
    df = intervals.valid_at(_kg(spark, rows), spark.createDataFrame([(s,) for s in subjects], "x string"), "v.from", spark.createDataFrame(instants, "query_id string, at date"))
    plan = _plan(df)
    assert "NestedLoop" not in plan and "Cartesian" not in plan

    def fits(s, p, ok):
        vals = [r[2] for r in rows if r[0] == s and r[1] == p]
        return not vals or any(v != "not a date" and ok(date.fromisoformat(v)) for v in vals)
    want = {(q, s) for q, at in instants if at for s in subjects if fits(s, "v.from", lambda d: d <= at) and fits(s, "v.to", lambda d: d >= at)}  # noqa: B023
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("chunk", [4096, 2])
def test_places_leave_no_path_between_like_nodes(spark, chunk):
    """Lists hold the third place only; a four-cycle's top needs lower neighbours at both places beside it."""
    rng = random.Random(9)
    pick = lambda a, b, n: {(f"{a}|{rng.randrange(9)}", f"{b}|{rng.randrange(9)}") for _ in range(n)}
    ab, bc, ac = pick(0, 1, 40), pick(1, 2, 30), pick(0, 2, 20)
    df = spark.createDataFrame(sorted(ab | bc | ac), "u string, v string")
    want = sorted((a, b, c) for a, b in ab for b2, c in bc if b2 == b and (a, c) in ac)
    assert sorted(tuple(sorted(r)) for r in cycles.triangles(df, chunk, places=True).collect()) == want and want
    cd, ad = pick(2, 3, 40), pick(0, 3, 20)
    df = spark.createDataFrame(sorted(ab | bc | cd | ad), "u string, v string")
    want = sorted((a, b, c, d) for a, b in ab for b2, c in bc if b2 == b for c2, d in cd if c2 == c and (a, d) in ad)
    assert sorted(tuple(sorted(r)) for r in cycles._typed_four_cycles(df, {0: 2, 2: 0, 1: 3, 3: 1}).collect()) == want and want
