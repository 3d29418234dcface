"""Graph queries beyond one chain: cycles, semi-join chains, copies at rest, per-group arg max, class chains, instants in batches, and terms
that are literals.  Same form as ``kg_queries``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgflow.operators import cycles, intervals
from kgflow.operators.graph import KG, Lit, narrow_class, subtype_closure, with_inverses
from kgflow.plans.fixture_sql import with_triples
from kgflow.plans.kg_queries import NATION, PRICE_CENTS, REGION, SQL_INVERSE_PAIRS, inverse_table, kg
from kgflow.session import shared_path
from kgflow.sources.fixtures import kg_sources
from kgflow.sources.tables import Tables
from kgflow.sources.triples import Attr, read_layout, to_triples, write_layouts

def n_rows():
    return F.count(F.lit(1)).alias("n")



def _with(spark, sf, extra: dict) -> KG:
    """The fixture graph with further predicates."""
    t = Tables(spark, sf)
    return KG(sources=kg_sources(t) | {p: [build] for p, build in extra.items()}, spark=spark)


def _sold(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey")
    return lines.join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")


# --- K23: cycles ------------------------------------------------------------------

def kg_triangle_closed(spark, sf):
    """K23 triangle: customers and the suppliers from their own nation that they bought from, counted per nation."""
    t = Tables(spark, sf)
    g = _with(spark, sf, {"trades_with": lambda: to_triples(_sold(t), F.concat(F.lit("cust_"), "o_custkey"), [Attr("trades_with", F.concat(F.lit("supp_"), "l_suppkey"))])})
    found = cycles.match_triangle(g, [("?c", "trades_with", "?s"), ("?s", "in_nation", "?nation"), ("?c", "in_nation", "?nation")])
    return found.groupBy("nation").agg(n_rows())


SQL_TRIANGLE_CLOSED = """
with sold as (select distinct o_custkey, l_suppkey from lineitem join orders on l_orderkey = o_orderkey)
select 'nat_' || c_nationkey as nation, count(*) as n
from sold join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey and s_nationkey = c_nationkey group by 1"""


def kg_four_cycle(spark, sf):
    """K23 four-cycle: customer, part that they bought, supplier of that part (to anyone) and the nation of both, counted per nation."""
    t = Tables(spark, sf)
    g = _with(spark, sf, {"bought": lambda: to_triples(_sold(t), F.concat(F.lit("cust_"), "o_custkey"), [Attr("bought", F.concat(F.lit("part_"), "l_partkey"))])})
    found = cycles.match_four_cycle(g, [("?c", "bought", "?p"), ("?p", "supplied_by", "?s"), ("?s", "in_nation", "?nation"), ("?c", "in_nation", "?nation")])
    return found.groupBy("nation").agg(n_rows())


SQL_FOUR_CYCLE = """
with bought as (select distinct o_custkey, l_partkey from lineitem join orders on l_orderkey = o_orderkey),
supplied as (select distinct l_partkey, l_suppkey from lineitem)
select 'nat_' || c_nationkey as nation, count(*) as n
from bought b join supplied d on b.l_partkey = d.l_partkey join customer on o_custkey = c_custkey
join supplier on d.l_suppkey = s_suppkey and s_nationkey = c_nationkey group by 1"""


# --- K3 / K4 by semi-joins ----------------------------------------------------------

def kg_semi_chain(spark, sf):
    """K1 -> K3 -> K3 -> K4 without intermediates: parts ordered by customers of one region."""
    g = kg(spark, sf)
    b = g.having("in_region", REGION).step_in("in_nation", keep=False).step_in("placed_by", keep=False)
    return b.step_out("contains", keep=False).answer()


SQL_SEMI_CHAIN = with_triples(f"""
select distinct t4.o as x
from triples t1 join triples t2 on t2.o = t1.s join triples t3 on t3.o = t2.s join triples t4 on t4.s = t3.s
where t1.p = 'in_region' and t1.o = '{REGION}' and t2.p = 'in_nation' and t3.p = 'placed_by' and t4.p = 'contains'""")


def kg_chain_participants(spark, sf):
    """The nodes on whole chains region <- nation <- customer <- order of at least v: both passes of the reduction, counted per place."""
    g = kg(spark, sf)
    sets = g.participants(g.instances("Region"), ["in_region", "in_nation", "placed_by"], g.compare("total_price", "ge", PRICE_CENTS))
    return reduce(DataFrame.unionByName, [s.agg(n_rows()).select(F.lit(i).alias("place"), "n") for i, s in enumerate(sets)])


SQL_CHAIN_PARTICIPANTS = with_triples(f"""
, c as (select a.o as x0, a.s as x1, b.s as x2, d.s as x3 from triples a join triples b on b.o = a.s join triples d on d.o = b.s
  join triples e on e.s = d.s and e.p = 'total_price' and try_cast(e.o as bigint) >= {PRICE_CENTS}
  join triples y on y.s = a.o and y.p = 'type.object.type' and y.o = 'Region'
  where a.p = 'in_region' and b.p = 'in_nation' and d.p = 'placed_by')
select 0 as place, count(distinct x0) as n from c union all select 1, count(distinct x1) from c
union all select 2, count(distinct x2) from c union all select 3, count(distinct x3) from c""")


# --- S6: two copies at rest -----------------------------------------------------------

def kg_object_lookup(spark, sf):
    """S6 written in two layouts and read back: K1 and K3 on the copy sorted by object, K4 on the one sorted by subject; orders per status."""
    t = Tables(spark, sf)
    src = kg_sources(t)
    whole = KG(sources={p: src[p] for p in ("in_region", "in_nation", "placed_by", "status")}, spark=spark).triples
    path = shared_path(spark, "kg")
    write_layouts(whole, path, tail_rows=100)
    g = KG.at_rest(spark, path)
    b = g.having("in_region", REGION).step_in("in_nation").step_in("placed_by").step_out("status")
    return b.df.groupBy("x").agg(n_rows())


SQL_OBJECT_LOOKUP = with_triples(f"""
select t4.o as x, count(*) as n
from triples t1 join triples t2 on t2.o = t1.s join triples t3 on t3.o = t2.s join triples t4 on t4.s = t3.s
where t1.p = 'in_region' and t1.o = '{REGION}' and t2.p = 'in_nation' and t3.p = 'placed_by' and t4.p = 'status' group by 1""")


def kg_paths_at_rest(spark, sf):
    """K24 over the copies at rest: of every nation's customers, the statuses of their orders (a path that ends at literals; the
    queries of odd nations ask for a further hop, which literals do not have)."""
    t = Tables(spark, sf)
    src = kg_sources(t)
    path = shared_path(spark, "kg")
    write_layouts(KG(sources={p: src[p] for p in ("in_nation", "placed_by", "status", "label")}, spark=spark).triples, path, tail_rows=100)
    seeds, steps = _literal_paths(t)
    return KG.at_rest(spark, path).answer_paths(seeds, steps).groupBy("query_id").agg(n_rows())


def kg_paths_literal(spark, sf):
    """K24 over the lazy graph: the same paths."""
    t = Tables(spark, sf)
    seeds, steps = _literal_paths(t)
    return KG(sources=kg_sources(t), spark=spark).answer_paths(seeds, steps).groupBy("query_id").agg(n_rows())


def _literal_paths(t: Tables) -> tuple[DataFrame, DataFrame]:
    q = F.col("n_nationkey").cast("bigint").alias("query_id")
    seeds = t.nation.select(q, F.concat(F.lit("nat_"), "n_nationkey").alias("x"))
    hops = [("in_nation", True), ("placed_by", True), ("status", False), ("label", False)]
    path = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(p).alias("p"), F.lit(inv).alias("inverse")) for i, (p, inv) in enumerate(hops, 1)])
    path = F.slice(path, 1, F.when(F.col("n_nationkey") % 2 == 0, 3).otherwise(4))
    return seeds, t.nation.select(q, F.explode(path).alias("st")).select("query_id", "st.*")


SQL_PATHS_LITERAL = with_triples("""
select cast(n_nationkey as bigint) as query_id, count(distinct c.o) as n from nation
join triples a on a.p = 'in_nation' and a.o = 'nat_' || n_nationkey join triples b on b.p = 'placed_by' and b.o = a.s
join triples c on c.p = 'status' and c.s = b.s where n_nationkey % 2 = 0 group by 1""")


def kg_with_inverses_at_rest(spark, sf):
    """K25 over a copy at rest: only the partitions of the predicates with an inverse are read twice; triples counted per predicate."""
    t = Tables(spark, sf)
    src = kg_sources(t)
    path = shared_path(spark, "kg")
    write_layouts(KG(sources={p: src[p] for p in ("in_region", "in_nation", "placed_by", "status", "label")}, spark=spark).triples, path, tail_rows=100)
    return with_inverses(read_layout(spark, path, "s"), inverse_table(spark)).groupBy("p").agg(n_rows())


SQL_WITH_INVERSES_AT_REST = with_triples(f"""
, kept as (select * from triples where p in ('in_region', 'in_nation', 'placed_by', 'status', 'label')),
inv as (select * from {SQL_INVERSE_PAIRS}),
added as (select distinct t.o as s, inv.p_inv as p, t.s as o from kept t join inv on t.p = inv.p where t.o_kind = 'iri')
select p, count(*) as n from (select s, p, o from kept union all select * from added) group by p""")


# --- K15 per group ----------------------------------------------------------------------

def kg_argmax_per_nation(spark, sf):
    """K15 per group: of every nation of a region the priciest order of its customers (ties to the smallest order name)."""
    g = kg(spark, sf)
    b = g.having("in_region", REGION).step_in("in_nation").step_in("placed_by")
    return b.argmax_per("v1", "total_price").select(F.col("v1").alias("nation"), "x", F.col("arg").cast("bigint").alias("arg"))


def kg_argmin_per_customer(spark, sf):
    """K15 per group: of every customer the earliest order (a date, so text order; ties to the smallest order name)."""
    g = kg(spark, sf)
    return g.instances("Customer").step_in("placed_by").argmin_per("v1", "order_date").select(F.col("v1").alias("customer"), "x", "arg")


SQL_ARGMAX_PER_NATION = with_triples(f"""
select nation, x, arg from (
  select t2.o as nation, t3.s as x, cast(tp.o as bigint) as arg, row_number() over (partition by t2.o order by cast(tp.o as bigint) desc, t3.s) as rn
  from triples t1 join triples t2 on t2.o = t1.s join triples t3 on t3.o = t2.s join triples tp on tp.s = t3.s and tp.p = 'total_price'
  where t1.p = 'in_region' and t1.o = '{REGION}' and t2.p = 'in_nation' and t3.p = 'placed_by') where rn = 1""")

SQL_ARGMIN_PER_CUSTOMER = with_triples("""
select customer, x, arg from (
  select a.o as customer, a.s as x, d.o as arg, row_number() over (partition by a.o order by d.o, a.s) as rn
  from triples a join triples d on d.s = a.s and d.p = 'order_date' where a.p = 'placed_by') where rn = 1""")


# --- K27 over chains ----------------------------------------------------------------------

def _class_pairs(t: Tables) -> DataFrame:
    """Brand below type, type below Part, Part below Thing; Thing and Entity above each other."""
    brand = t.part.select(F.concat("p_brand", F.lit("/"), "p_type").alias("t"), F.col("p_type").alias("super"))
    kind = t.part.where("p_type <> 'SMALL'").select(F.col("p_type").alias("t"), F.lit("Part").alias("super"))
    top = t.part.limit(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("t"), F.lit(b).alias("super")) for a, b in (
        ("Part", "Thing"), ("Thing", "Entity"), ("Entity", "Thing"))])).alias("e")).select("e.*")
    return brand.unionByName(kind).unionByName(top).distinct()


def kg_subtype_closure(spark, sf):
    """All classes above each class."""
    return subtype_closure(_class_pairs(Tables(spark, sf)))


def kg_narrow_chain(spark, sf):
    """K27 over the closure: parts stated as Thing, with a relation that implies their brand's class, two to four levels below."""
    t = Tables(spark, sf)
    nodes = t.part.select(F.concat(F.lit("part_"), "p_partkey").alias("x"), F.lit("Thing").alias("cls"), F.concat("p_brand", F.lit("/"), "p_type").alias("rel_cls"))
    return narrow_class(nodes, subtype_closure(_class_pairs(t)), "cls", "rel_cls").groupBy("narrowed").agg(n_rows())


SQL_CLASS_PAIRS = """
with recursive d as (select distinct p_brand || '/' || p_type as t, p_type as super from part
  union select p_type, 'Part' from part where p_type <> 'SMALL' union select 'Part', 'Thing' union select 'Thing', 'Entity' union select 'Entity', 'Thing'),
c(t, super) as (select t, super from d union select c.t, d.super from c join d on d.t = c.super),
closed as (select t, super from c where t <> super)"""

SQL_SUBTYPE_CLOSURE = SQL_CLASS_PAIRS + " select t, super from closed"

SQL_NARROW_CHAIN = SQL_CLASS_PAIRS + """
select case when s.t is not null then n.rel else 'Thing' end as narrowed, count(*) as n
from (select p_brand || '/' || p_type as rel from part) n left join closed s on s.t = n.rel and s.super = 'Thing' group by 1"""


# --- K13 for a batch of instants ----------------------------------------------------------

def kg_valid_at_batch(spark, sf):
    """For the first day of every month with an order, the customers of one region that are active then, counted."""
    t, g = Tables(spark, sf), kg(spark, sf)
    day = F.trunc(F.col("o_orderdate").cast("date"), "month")
    instants = t.orders.select(F.date_format(day, "yyyy-MM").alias("query_id"), day.alias("at")).distinct()
    who = g.having("in_region", REGION).step_in("in_nation").is_a("Customer").answer()
    return intervals.valid_at(g, who, "active.from", instants).groupBy("query_id").agg(n_rows())


SQL_VALID_AT_BATCH = with_triples(f"""
, w as (select distinct b.s as x from triples a join triples b on b.o = a.s join triples y on y.s = b.s and y.p = 'type.object.type' and y.o = 'Customer'
        where a.p = 'in_region' and a.o = '{REGION}' and b.p = 'in_nation'),
i as (select distinct cast(date_trunc('month', o_orderdate) as date) as d from orders)
select strftime(d, '%Y-%m') as query_id, count(*) as n from i, w
where (not exists (select 1 from triples f where f.s = w.x and f.p = 'active.from')
       or exists (select 1 from triples f where f.s = w.x and f.p = 'active.from' and try_cast(f.o as date) <= i.d))
  and (not exists (select 1 from triples e where e.s = w.x and e.p = 'active.to')
       or exists (select 1 from triples e where e.s = w.x and e.p = 'active.to' and try_cast(e.o as date) >= i.d))
group by 1""")


# --- the remaining branches of K5, K12, K20, K23 --------------------------------------------

def kg_of_value(spark, sf):
    """K5, reverse branch: orders of a date, from an inverse relation whose subjects are the dates (as text with the zone suffix that this branch adds)."""
    t = Tables(spark, sf)
    g = _with(spark, sf, {"date_of": lambda: to_triples(t.orders, F.concat(F.col("o_orderdate").cast("date").cast("string"), F.lit("-08:00")), [
        Attr("date_of", F.concat(F.lit("ord_"), "o_orderkey"), unique=True)])})
    return g.of_value("date_of", "1997-08-23", "xsd:date").answer()


SQL_OF_VALUE = "select 'ord_' || o_orderkey as x from orders where cast(o_orderdate as date) = date '1997-08-23'"


def kg_shared_mediator(spark, sf):
    """K12 twice: customers with one order above v that is dated from 1997 on, the order being the shared mediator, and customers with two such
    orders that may differ."""
    g = kg(spark, sf)
    first = g.compare2("placed_by", "total_price", "gt", PRICE_CENTS, reverse1=True)
    same = first.compare2("placed_by", "order_date", "ge", "1997-01-01", shared_mediator="v1", reverse1=True)
    own = first.compare2("placed_by", "order_date", "ge", "1997-01-01", reverse1=True)
    return (same.answer().withColumn("mediator", F.lit("shared")).unionByName(own.answer().withColumn("mediator", F.lit("own")))
            .groupBy("mediator").agg(n_rows()))


SQL_SHARED_MEDIATOR = with_triples(f"""
, a as (select t.o as x, t.s as m from triples t join triples p on p.s = t.s where t.p = 'placed_by' and p.p = 'total_price' and try_cast(p.o as bigint) > {PRICE_CENTS}),
b as (select t.o as x, t.s as m from triples t join triples p on p.s = t.s where t.p = 'placed_by' and p.p = 'order_date' and try_cast(p.o as date) >= date '1997-01-01')
select 'shared' as mediator, count(distinct a.x) as n from a join b on a.x = b.x and a.m = b.m
union all select 'own', count(distinct a.x) from a join b on a.x = b.x""")


def kg_exclude_mentioned(spark, sf):
    """K20 with the terms of a form: open-domain ids (``m.``) that it mentions are no answers, its relations and closed-domain ids do not matter."""
    t = Tables(spark, sf)
    name = lambda c: F.concat(F.lit("m."), F.col(c))
    g = KG(sources={"m.in": [lambda: to_triples(t.nation, name("n_nationkey"), [Attr("m.in", F.concat(F.lit("g."), "n_regionkey"), unique=True)])]}, spark=spark)
    return g.of("m.in", "m.7").step_in("m.in").exclude_mentioned(["m.7", "m.in", "nat_8", "JOIN"]).answer()


SQL_EXCLUDE_MENTIONED = """
select 'm.' || b.n_nationkey as x from nation a join nation b on a.n_regionkey = b.n_regionkey where a.n_nationkey = 7 and b.n_nationkey <> 7"""


def kg_pattern_literal(spark, sf):
    """K23 with a literal constant and a literal variable: orders that contain a part labelled 'small widget'@en, per status."""
    g = kg(spark, sf)
    m = g.match([("?part", "label", Lit("small widget", "en")), ("?ord", "contains", "?part"), ("?ord", "status", "?st"), ("?ord", "placed_by", "?c"), ("?c", "in_nation", NATION)],
                select=["ord", "st"], distinct=True)
    return m.groupBy("st").agg(n_rows())


SQL_PATTERN_LITERAL = with_triples(f"""
select c.o as st, count(distinct b.s) as n from triples a join triples b on b.o = a.s join triples c on c.s = b.s join triples d on d.s = b.s join triples e on e.s = d.o
where a.p = 'label' and a.o = 'small widget' and a.o_lang = 'en' and b.p = 'contains' and c.p = 'status' and d.p = 'placed_by'
  and e.p = 'in_nation' and e.o = '{NATION}' group by 1""")


QUERIES = {
    "kg_triangle_closed": (kg_triangle_closed, SQL_TRIANGLE_CLOSED),
    "kg_four_cycle": (kg_four_cycle, SQL_FOUR_CYCLE),
    "kg_semi_chain": (kg_semi_chain, SQL_SEMI_CHAIN),
    "kg_chain_participants": (kg_chain_participants, SQL_CHAIN_PARTICIPANTS),
    "kg_object_lookup": (kg_object_lookup, SQL_OBJECT_LOOKUP),
    "kg_paths_at_rest": (kg_paths_at_rest, SQL_PATHS_LITERAL),
    "kg_paths_literal": (kg_paths_literal, SQL_PATHS_LITERAL),
    "kg_with_inverses_at_rest": (kg_with_inverses_at_rest, SQL_WITH_INVERSES_AT_REST),
    "kg_argmax_per_nation": (kg_argmax_per_nation, SQL_ARGMAX_PER_NATION),
    "kg_argmin_per_customer": (kg_argmin_per_customer, SQL_ARGMIN_PER_CUSTOMER),
    "kg_subtype_closure": (kg_subtype_closure, SQL_SUBTYPE_CLOSURE),
    "kg_narrow_chain": (kg_narrow_chain, SQL_NARROW_CHAIN),
    "kg_valid_at_batch": (kg_valid_at_batch, SQL_VALID_AT_BATCH),
    "kg_of_value": (kg_of_value, SQL_OF_VALUE),
    "kg_shared_mediator": (kg_shared_mediator, SQL_SHARED_MEDIATOR),
    "kg_exclude_mentioned": (kg_exclude_mentioned, SQL_EXCLUDE_MENTIONED),
    "kg_pattern_literal": (kg_pattern_literal, SQL_PATTERN_LITERAL),
}
