"""Knowledge-graph queries (K operators) over the fixture graph F1.

Each entry is ``name -> (callable(spark, sf_dir) -> DataFrame, oracle SQL)``.
The SQL runs in DuckDB over the same driver tables (via ``with_triples``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgflow.operators.graph import KG, Bindings, classify_terms, end_property_col, narrow_class, with_inverses
from kgflow.plans.fixture_sql import with_triples
from kgflow.sources.fixtures import kg_sources
from kgflow.sources.tables import Tables

REGION = "reg_2"
NATION = "nat_7"
PRICE_CENTS = 40000000          # 400,000.00
YEAR = 1998
EN_PATTERN = "^en(-.*)?$"


def kg(spark: SparkSession, sf_dir: str) -> KG:
    return KG(sources=kg_sources(Tables(spark, sf_dir)), spark=spark)


def _last_var(b: Bindings) -> str:
    vs = [c for c in b.df.columns if c[0] == "v" and c[1:].isdigit()]
    return max(vs, key=lambda c: int(c[1:]))


# --- flagships -----------------------------------------------------------------

def kg_three_hop(spark, sf):
    """Orders of customers in nations of one region: K1 -> K3 -> K3 -> K21 -> K19."""
    g = kg(spark, sf)
    return (g.having("in_region", REGION).step_in("in_nation").step_in("placed_by")
            .exclude_intermediates().answer())


SQL_THREE_HOP = with_triples(f"""
select distinct t3.s as x
from triples t1 join triples t2 on t2.o = t1.s join triples t3 on t3.o = t2.s
where t1.p = 'in_region' and t1.o = '{REGION}' and t2.p = 'in_nation' and t3.p = 'placed_by'
  and t3.s <> t2.s and t3.s <> t1.s""")


def kg_priciest_order(spark, sf):
    """Flagship: three-hop + is_a Order + total_price >= v, then ARGMAX total_price."""
    g = kg(spark, sf)
    b = (g.having("in_region", REGION).step_in("in_nation").step_in("placed_by")
         .is_a("Order").compare("total_price", "ge", PRICE_CENTS).argmax("total_price"))
    return b.df.select("x", F.col(_last_var(b)).try_cast("bigint").alias("arg0"))


SQL_PRICIEST = with_triples(f"""
select t3.s as x, cast(tp.o as bigint) as arg0
from triples t1 join triples t2 on t2.o = t1.s join triples t3 on t3.o = t2.s
join triples ty on ty.s = t3.s and ty.p = 'type.object.type' and ty.o = 'Order'
join triples tp on tp.s = t3.s and tp.p = 'total_price'
where t1.p = 'in_region' and t1.o = '{REGION}' and t2.p = 'in_nation' and t3.p = 'placed_by'
  and try_cast(tp.o as bigint) >= {PRICE_CENTS}
order by try_cast(tp.o as double) desc nulls last, tp.o desc, t3.s
limit 1""")


def kg_two_hop_compare(spark, sf):
    """Customers with an order over v: K12 with the first hop reversed -> K18."""
    g = kg(spark, sf)
    return g.compare2("placed_by", "total_price", "gt", PRICE_CENTS, reverse1=True).count()


SQL_TWO_HOP_COMPARE = with_triples(f"""
select count(distinct a.o) as n
from triples a join triples b on b.s = a.s
where a.p = 'placed_by' and b.p = 'total_price' and try_cast(b.o as bigint) > {PRICE_CENTS}""")


def kg_valid_during(spark, sf):
    """Customers of one region active during a year: K1, K3, K10, K13, K19."""
    g = kg(spark, sf)
    return (g.having("in_region", REGION).step_in("in_nation").is_a("Customer")
            .valid_during("active.from", YEAR).answer())


SQL_VALID_DURING = with_triples(f"""
, c as (
  select t2.s as x from triples t1 join triples t2 on t2.o = t1.s
  join triples ty on ty.s = t2.s and ty.p = 'type.object.type' and ty.o = 'Customer'
  where t1.p = 'in_region' and t1.o = '{REGION}' and t2.p = 'in_nation')
select distinct x from c
where (not exists (select 1 from triples f where f.s = c.x and f.p = 'active.from')
       or exists (select 1 from triples f where f.s = c.x and f.p = 'active.from'
                  and try_cast(f.o as date) <= date '{YEAR}-12-31'))
  and (not exists (select 1 from triples e where e.s = c.x and e.p = 'active.to')
       or exists (select 1 from triples e where e.s = c.x and e.p = 'active.to'
                  and try_cast(e.o as date) >= date '{YEAR}-01-01'))""")


def kg_label_prefix(spark, sf):
    """Labels of parts whose label starts with 'small', English or untagged only:
    K8 -> K4 -> K22, solutions counted per label."""
    g = kg(spark, sf)
    b = g.value_startswith("label", "small").step_out("label").lang("en")
    return b.df.groupBy("x").agg(F.count(F.lit(1)).alias("n"))


SQL_LABEL_PREFIX = with_triples(f"""
select b.o as x, count(*) as n
from triples a join triples b on b.s = a.s
where a.p = 'label' and starts_with(a.o, 'small') and b.p = 'label'
  and (b.o_kind <> 'literal' or b.o_lang = '' or regexp_matches(lower(b.o_lang), '{EN_PATTERN}'))
group by b.o""")


def _path_inputs(t: Tables) -> tuple[DataFrame, DataFrame]:
    seeds = t.region.select(F.col("r_regionkey").cast("bigint").alias("query_id"),
                            F.concat(F.lit("reg_"), "r_regionkey").alias("x"))
    last = F.when(F.col("r_regionkey") % 2 == 0, "placed_by").otherwise("supplied_by")
    steps = t.region.select(F.col("r_regionkey").cast("bigint").alias("query_id"), F.explode(F.array(
        F.struct(F.lit(1).alias("step"), F.lit("in_region").alias("p"), F.lit(True).alias("inverse")),
        F.struct(F.lit(2).alias("step"), F.lit("in_nation").alias("p"), F.lit(True).alias("inverse")),
        F.struct(F.lit(3).alias("step"), last.alias("p"), F.lit(True).alias("inverse")),
    )).alias("st")).select("query_id", "st.*")
    return seeds, steps


def kg_paths_batch(spark, sf):
    """One seed per region, three reverse steps (orders for even regions,
    parts for odd ones), distinct answers counted per query: K24, K18."""
    t = Tables(spark, sf)
    g = KG(sources=kg_sources(t), spark=spark)
    seeds, steps = _path_inputs(t)
    return g.answer_paths(seeds, steps).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


SQL_PATHS_BATCH = with_triples("""
select cast(r.r_regionkey as bigint) as query_id, count(distinct t3.s) as n
from region r
join triples t1 on t1.p = 'in_region' and t1.o = concat('reg_', r.r_regionkey)
join triples t2 on t2.p = 'in_nation' and t2.o = t1.s
join triples t3 on t3.o = t2.s and t3.p = case when r.r_regionkey % 2 = 0 then 'placed_by' else 'supplied_by' end
group by r.r_regionkey""")


def kg_triangle(spark, sf):
    """Basic graph pattern (K23): orders whose part is supplied from the
    customer's own nation, counted per nation."""
    g = kg(spark, sf)
    m = g.match([("?ord", "placed_by", "?c"), ("?c", "in_nation", "?n"), ("?ord", "contains", "?part"),
                 [("?part", "supplied_by", "?supp"), ("?supp", "in_nation", "?n")]],
                select=["ord", "n"], distinct=True)
    return m.groupBy("n").agg(F.count(F.lit(1)).alias("n_orders"))


SQL_TRIANGLE = with_triples("""
select b.o as n, count(distinct a.s) as n_orders
from triples a join triples b on b.s = a.o join triples c on c.s = a.s
join triples d on d.s = c.o join triples e on e.s = d.o and e.o = b.o
where a.p = 'placed_by' and b.p = 'in_nation' and c.p = 'contains' and d.p = 'supplied_by' and e.p = 'in_nation'
group by b.o""")


# --- one query per remaining operator ------------------------------------------

def kg_of(spark, sf):
    """K2 then K3 twice: customers and suppliers in the region of one nation."""
    g = kg(spark, sf)
    return g.of("in_region", NATION).step_in("in_region").step_in("in_nation").exclude_intermediates().answer()


SQL_OF = with_triples(f"""
select distinct c.s as x from triples a join triples b on b.o = a.o join triples c on c.o = b.s
where a.p = 'in_region' and a.s = '{NATION}' and b.p = 'in_region' and c.p = 'in_nation'
  and c.s <> a.o and c.s <> b.s""")


def kg_step_out(spark, sf):
    """K1 -> K3 -> K4: parts ordered by customers of one nation."""
    g = kg(spark, sf)
    return g.having("in_nation", NATION).step_in("placed_by").step_out("contains").exclude_intermediates().answer()


SQL_STEP_OUT = with_triples(f"""
select distinct c.o as x from triples a join triples b on b.o = a.s join triples c on c.s = b.s
where a.p = 'in_nation' and a.o = '{NATION}' and b.p = 'placed_by' and c.p = 'contains'
  and c.o <> a.s and c.o <> b.s""")


def kg_having_value(spark, sf):
    """K5 typed literal: customers with an order on the busiest-day style date."""
    g = kg(spark, sf)
    return (g.having_value("order_date", "1997-08-23", "http://www.w3.org/2001/XMLSchema#date")
            .step_out("placed_by").exclude_intermediates().answer())


SQL_HAVING_VALUE = with_triples("""
select distinct b.o as x from triples a join triples b on b.s = a.s
where a.p = 'order_date' and a.o = '1997-08-23' and a.o_datatype = 'date' and b.p = 'placed_by' and b.o <> a.s""")


def kg_class_object(spark, sf):
    """K6 class object: suppliers (``JOIN type.object.type Supplier``) per nation."""
    g = kg(spark, sf)
    b = g.having_class_object("type.object.type", "Supplier").step_out("in_nation")
    return b.df.groupBy("x").agg(F.count(F.lit(1)).alias("n"))


SQL_CLASS_OBJECT = with_triples("""
select b.o as x, count(*) as n from triples a join triples b on b.s = a.s
where a.p = 'type.object.type' and a.o = 'Supplier' and b.p = 'in_nation' group by b.o""")


def kg_having_text(spark, sf):
    """K7 multi-word tagged literal: orders containing a part labelled
    'small widget'@en."""
    g = kg(spark, sf)
    return g.having_text("label", "small widget", "en").step_in("contains").count()


SQL_HAVING_TEXT = with_triples("""
select count(distinct b.s) as n from triples a join triples b on b.o = a.s
where a.p = 'label' and a.o = 'small widget' and a.o_lang = 'en' and b.p = 'contains'""")


def kg_intersect(spark, sf):
    """K9: orders of customers in one nation AND orders with status F."""
    g = kg(spark, sf)
    b = g.having("in_nation", NATION).step_in("placed_by").intersect_on_x(g.having_text("status", "F"))
    return b.exclude_intermediates().answer()


SQL_INTERSECT = with_triples(f"""
select distinct b.s as x from triples a join triples b on b.o = a.s join triples c on c.s = b.s
where a.p = 'in_nation' and a.o = '{NATION}' and b.p = 'placed_by' and c.p = 'status' and c.o = 'F'
  and b.s <> a.s""")


def kg_end_property(spark, sf):
    """K14 as a column function over every predicate of the graph."""
    g = kg(spark, sf)
    ps = g.triples.select("p").distinct()
    return ps.select("p", end_property_col(F.col("p")).alias("p_end"))


SQL_END_PROPERTY = with_triples("""
select p, case
  when regexp_extract(p, '[^.]*$') = 'from' then regexp_extract(p, '^(.*\\.)[^.]*$', 1) || 'to'
  when regexp_extract(p, '[^.]*$') in ('end_date', 'start_date') then regexp_extract(p, '^(.*\\.)[^.]*$', 1) || 'end_date'
  else regexp_extract(p, '^(.*\\.)[^.]*$', 1) || 'to_date' end as p_end
from (select distinct p from triples)""")


def kg_argmin_class(spark, sf):
    """The cheapest order (class as first argument of ARGMIN)."""
    g = kg(spark, sf)
    b = g.argmin_class("Order", "total_price")
    return b.df.select("x", F.col(_last_var(b)).try_cast("bigint").alias("arg0"))


SQL_ARGMIN_CLASS = with_triples("""
select a.s as x, cast(b.o as bigint) as arg0 from triples a join triples b on b.s = a.s
where a.p = 'type.object.type' and a.o = 'Order' and b.p = 'total_price'
order by try_cast(b.o as double) nulls last, b.o, a.s limit 1""")


def kg_argmax_path(spark, sf):
    """The customer with the priciest order, via the chain
    ``(R placed_by) -> total_price``."""
    g = kg(spark, sf)
    b = g.instances("Customer").argmax([("R", "placed_by"), "total_price"])
    return b.df.select("x", F.col(_last_var(b)).try_cast("bigint").alias("arg0"))


SQL_ARGMAX_PATH = with_triples("""
select a.s as x, cast(c.o as bigint) as arg0 from triples a
join triples b on b.o = a.s join triples c on c.s = b.s
where a.p = 'type.object.type' and a.o = 'Customer' and b.p = 'placed_by' and c.p = 'total_price'
order by try_cast(c.o as double) desc nulls last, c.o desc, a.s limit 1""")


def kg_exclude_entities(spark, sf):
    """The other nations of a nation's region."""
    g = kg(spark, sf)
    return g.of("in_region", NATION).step_in("in_region").exclude_entities([NATION]).answer()


SQL_EXCLUDE_ENTITIES = with_triples(f"""
select distinct b.s as x from triples a join triples b on b.o = a.o
where a.p = 'in_region' and a.s = '{NATION}' and b.p = 'in_region' and b.s <> '{NATION}'""")


def inverse_table(spark: SparkSession) -> DataFrame:
    # Fixed inverse names for the fixture graph's relations.
    rows = [("placed_by", "places"), ("in_nation", "has_member"), ("in_region", "has_nation"),
            ("contains", "contained_in"), ("supplied_by", "supplies")]
    return spark.createDataFrame(rows, "p string, p_inv string")


SQL_INVERSE_PAIRS = """(values ('placed_by', 'places'), ('in_nation', 'has_member'), ('in_region', 'has_nation'),
 ('contains', 'contained_in'), ('supplied_by', 'supplies')) as inv(p, p_inv)"""


def kg_with_inverses(spark, sf):
    """Materialise inverse relations; triples counted per predicate."""
    t = kg(spark, sf).triples
    return with_inverses(t, inverse_table(spark)).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


SQL_WITH_INVERSES = with_triples(f"""
, inv as (select * from {SQL_INVERSE_PAIRS}),
added as (select distinct t.o as s, inv.p_inv as p, t.s as o from triples t join inv on t.p = inv.p where t.o_kind = 'iri'),
allt as (select s, p, o from triples union all
         select s, p, o from added a where not exists (select 1 from triples t where t.s = a.s and t.p = a.p and t.o = a.o))
select p, count(*) as n from allt group by p""")


def _terms(g: KG) -> DataFrame:
    t = g.triples
    return t.select(F.when((F.col("o_kind") == "literal") & (F.col("o_datatype") != ""),
                           F.concat("o", F.lit("^^"), "o_datatype")).otherwise(F.col("o")).alias("term")).distinct()


def kg_classify_terms(spark, sf):
    """Every distinct object term classified against the graph's own
    classes and predicates; counted per kind."""
    g = kg(spark, sf)
    t = g.triples
    types = t.filter(F.col("p") == "type.object.type").select(F.col("o").alias("t"))
    rels = t.select(F.col("p").alias("r"))
    out = classify_terms(_terms(g), "term", types, rels)
    return out.groupBy("term_kind").agg(F.count(F.lit(1)).alias("n"))


SQL_CLASSIFY_TERMS = with_triples("""
, terms as (select distinct case when o_kind = 'literal' and o_datatype <> '' then o || '^^' || o_datatype else o end as term from triples),
ty as (select distinct o as t from triples where p = 'type.object.type'),
re as (select distinct p as r from triples)
select case when contains(term, '^^') then 'literal'
            when term in (select t from ty) then 'class'
            when term in (select r from re) then 'relation'
            when length(term) > 0 then 'entity' end as term_kind, count(*) as n
from terms group by 1""")


def kg_narrow_class(spark, sf):
    """Part nodes stated as class Part; the relation implies a class per
    part type, registered as a subtype of Part except for SMALL parts."""
    t = Tables(spark, sf)
    part = t.part
    nodes = part.select(F.concat(F.lit("part_"), "p_partkey").alias("x"), F.lit("Part").alias("cls"),
                        F.concat(F.initcap("p_type"), F.lit("Part")).alias("rel_cls"))
    subtype = (part.filter(F.col("p_type") != "SMALL")
               .select(F.concat(F.initcap("p_type"), F.lit("Part")).alias("t"), F.lit("Part").alias("super"))
               .distinct())
    out = narrow_class(nodes, subtype, "cls", "rel_cls")
    return out.groupBy("narrowed").agg(F.count(F.lit(1)).alias("n"))


SQL_NARROW_CLASS = """
with nodes as (select 'part_' || p_partkey as x, 'Part' as cls,
                      upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || 'Part' as rel_cls from part),
st as (select distinct upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || 'Part' as t, 'Part' as super
       from part where p_type <> 'SMALL')
select case when st.t is not null then n.rel_cls else n.cls end as narrowed, count(*) as n
from nodes n left join st on n.rel_cls = st.t and n.cls = st.super group by 1"""


QUERIES = {
    "kg_three_hop": (kg_three_hop, SQL_THREE_HOP),
    "kg_priciest_order": (kg_priciest_order, SQL_PRICIEST),
    "kg_two_hop_compare": (kg_two_hop_compare, SQL_TWO_HOP_COMPARE),
    "kg_valid_during": (kg_valid_during, SQL_VALID_DURING),
    "kg_label_prefix": (kg_label_prefix, SQL_LABEL_PREFIX),
    "kg_paths_batch": (kg_paths_batch, SQL_PATHS_BATCH),
    "kg_triangle": (kg_triangle, SQL_TRIANGLE),
    "kg_of": (kg_of, SQL_OF),
    "kg_step_out": (kg_step_out, SQL_STEP_OUT),
    "kg_having_value": (kg_having_value, SQL_HAVING_VALUE),
    "kg_class_object": (kg_class_object, SQL_CLASS_OBJECT),
    "kg_having_text": (kg_having_text, SQL_HAVING_TEXT),
    "kg_intersect": (kg_intersect, SQL_INTERSECT),
    "kg_end_property": (kg_end_property, SQL_END_PROPERTY),
    "kg_argmin_class": (kg_argmin_class, SQL_ARGMIN_CLASS),
    "kg_argmax_path": (kg_argmax_path, SQL_ARGMAX_PATH),
    "kg_exclude_entities": (kg_exclude_entities, SQL_EXCLUDE_ENTITIES),
    "kg_with_inverses": (kg_with_inverses, SQL_WITH_INVERSES),
    "kg_classify_terms": (kg_classify_terms, SQL_CLASSIFY_TERMS),
    "kg_narrow_class": (kg_narrow_class, SQL_NARROW_CLASS),
}
