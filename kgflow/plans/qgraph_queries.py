"""Query-graph corpus queries (G operators, K26/K27 live with the graph
queries) over F6: one query graph per order."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgflow.operators import qgraph as G
from kgflow.plans.fixture_sql import FORMS_SQL, QEDGES_SQL, QNODES_SQL
from kgflow.plans.kg_queries import SQL_INVERSE_PAIRS, inverse_table
from kgflow.sources.fixtures import qa_forms, query_graphs
from kgflow.sources.tables import Tables

ROUNDS = 3


def _graphs(spark, sf):
    return query_graphs(Tables(spark, sf))


def query_node_labels(spark, sf):
    """G2."""
    n, _ = _graphs(spark, sf)
    return G.node_labels(n)


SQL_NODE_LABELS = f"""select qid, nid, md5(concat_ws(chr(1), id, type, coalesce(function, 'none'), 'none')) as label
from ({QNODES_SQL})"""


def query_edge_bundles(spark, sf):
    """G1."""
    _, e = _graphs(spark, sf)
    return G.edge_bundles(e).withColumn("relations", F.array_join("relations", ","))


SQL_EDGE_BUNDLES = f"""select qid, src, dst, string_agg(relation, ',' order by relation) as relations
from ({QEDGES_SQL}) group by qid, src, dst"""


def query_reverse_edges(spark, sf):
    """Reverse edges for relations with an inverse."""
    _, e = _graphs(spark, sf)
    return G.with_reverse_edges(e, inverse_table(spark))


SQL_REVERSE_EDGES = f"""select distinct * from (
  select qid, src, dst, relation from ({QEDGES_SQL})
  union all select e.qid, e.dst as src, e.src as dst, inv.p_inv as relation
  from ({QEDGES_SQL}) e join {SQL_INVERSE_PAIRS} on e.relation = inv.p)"""


def query_wl_buckets(spark, sf):
    """G2 -> G3 (three rounds): per graph the hash of its refined colours."""
    n, e = _graphs(spark, sf)
    return G.wl_buckets_packed(n, e, ROUNDS)


def _wl_sql(rounds: int) -> str:
    parts = [f"n as ({QNODES_SQL}), e as ({QEDGES_SQL}),",
             "c0 as (select qid, nid, md5(concat_ws(chr(1), id, type, coalesce(function, 'none'), 'none')) as c from n),"]
    for k in range(1, rounds + 1):
        p = f"c{k - 1}"
        parts.append(f"""t{k} as (select e.qid, e.src as nid, '>' || e.relation || ':' || c.c as t from e join {p} c on c.qid = e.qid and c.nid = e.dst
  union all select e.qid, e.dst as nid, '<' || e.relation || ':' || c.c as t from e join {p} c on c.qid = e.qid and c.nid = e.src),
s{k} as (select qid, nid, string_agg(t, ',' order by t) as sig from t{k} group by qid, nid),
c{k} as (select c.qid, c.nid, md5(c.c || '|' || coalesce(s.sig, '')) as c from {p} c left join s{k} s using (qid, nid)),""")
    body = "\n".join(parts).rstrip(",")
    return f"""with {body}
select qid, md5(string_agg(c, ',' order by c)) as bucket, count(distinct c) = count(*) as discrete
from c{rounds} group by qid"""


SQL_WL_BUCKETS = _wl_sql(ROUNDS)


def query_classes(spark, sf):
    """Flagship G1 -> G2 -> G3 -> G4: equivalence classes of the query graphs
    and their sizes (class named by its smallest query id)."""
    n, e = _graphs(spark, sf)
    return G.class_sizes(n, e, ROUNDS)


# The oracle derives the expected classes from the generating attributes.
SQL_CLASSES = """select min(o_orderkey) as class_id, count(*) as size from orders
group by o_custkey % 5, o_orderstatus, o_orderpriority = '1-URGENT'"""


def forms_comparable(spark, sf):
    """Raw predictions that can be compared at all."""
    f = qa_forms(Tables(spark, sf))
    return f.agg(F.sum(G.comparable("raw_pred").cast("bigint")).alias("n_comparable"),
                 F.count(F.lit(1)).alias("n"))


SQL_FORMS_COMPARABLE = f"""select cast(sum(case when contains(raw_pred, '@@UNKNOWN@@') then 0 else 1 end) as bigint) as n_comparable,
  count(*) as n from ({FORMS_SQL})"""


QUERIES = {
    "query_node_labels": (query_node_labels, SQL_NODE_LABELS),
    "query_edge_bundles": (query_edge_bundles, SQL_EDGE_BUNDLES),
    "query_reverse_edges": (query_reverse_edges, SQL_REVERSE_EDGES),
    "query_wl_buckets": (query_wl_buckets, SQL_WL_BUCKETS),
    "query_classes": (query_classes, SQL_CLASSES),
    "forms_comparable": (forms_comparable, SQL_FORMS_COMPARABLE),
}
