"""Derived fixtures F1-F7: the inputs of the reference's workflow, derived
from the driver tables by Spark so that they grow with the data.

Each builder has a DuckDB twin in ``kgflow.plans.fixture_sql``; both sides
start every oracle comparison from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgflow.sources.tables import Tables, spread
from kgflow.sources.triples import Attr, to_triples, union_triples

# The ten relation names of the reference domain and their
# inverses, in the order the reference lists them.
INVERSE_PAIRS = [
    ("requirement", "required_for"),
    ("services", "services_by"),
    ("target_group", "target_group_for"),
    ("issued_by", "issues"),
    ("eligible_for", "target_group_for_document"),
]
RELATIONS = [r for pair in INVERSE_PAIRS for r in pair]
# F2 picks a part's relation in this order (key mod 10).
F2_RELATION_CYCLE = RELATIONS


def _date_str(c: str):
    return F.col(c).cast("date").cast("string")


def kg_sources(t: Tables) -> dict[str, list]:
    """F1 as lazy per-predicate branches: ``predicate -> [builder, ...]``.

    Classes Region/Nation/Customer/Supplier/Part/Order; relations in_region,
    in_nation, placed_by, contains, supplied_by; literals total_price
    (integer cents), order_date (date), status (plain), label (language
    tagged: en / fi / untagged by part key), and the optional interval
    active.from / active.to.  A customer in debt (negative balance) has no
    recorded start, a customer in the BUILDING segment no recorded end, so
    the time-validity operator sees open intervals on real rows.

    A query asks the graph for predicates; only their branches are built and
    scanned -- the lazy counterpart of a triples copy partitioned by ``p``.
    """
    def first():
        return (t.orders.groupBy("o_custkey").agg(F.min("o_orderdate").alias("d"))
                .join(t.customer.filter(F.col("c_acctbal") >= 0).select(F.col("c_custkey").alias("o_custkey")),
                      "o_custkey", "left_semi"))

    def last():
        return (t.orders.groupBy("o_custkey").agg(F.max("o_orderdate").alias("d"))
                .join(t.customer.filter(F.col("c_mktsegment") != "BUILDING")
                      .select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi"))

    def key(prefix, col):
        return F.concat(F.lit(prefix), F.col(col))

    cust = key("cust_", "o_custkey")
    lang = (F.when(F.col("p_partkey") % 3 == 0, "en").when(F.col("p_partkey") % 3 == 1, "fi")
            .otherwise(""))
    specs = [
        (lambda: t.region, key("reg_", "r_regionkey"), Attr("type.object.type", F.lit("Region"), unique=True)),
        (lambda: t.nation, key("nat_", "n_nationkey"), Attr("type.object.type", F.lit("Nation"), unique=True)),
        (lambda: t.customer, key("cust_", "c_custkey"), Attr("type.object.type", F.lit("Customer"), unique=True)),
        (lambda: t.supplier, key("supp_", "s_suppkey"), Attr("type.object.type", F.lit("Supplier"), unique=True)),
        (lambda: t.part, key("part_", "p_partkey"), Attr("type.object.type", F.lit("Part"), unique=True)),
        (lambda: t.orders, key("ord_", "o_orderkey"), Attr("type.object.type", F.lit("Order"), unique=True)),
        (lambda: t.nation, key("nat_", "n_nationkey"), Attr("in_region", key("reg_", "n_regionkey"), unique=True)),
        (lambda: t.customer, key("cust_", "c_custkey"), Attr("in_nation", key("nat_", "c_nationkey"), unique=True)),
        (lambda: t.supplier, key("supp_", "s_suppkey"), Attr("in_nation", key("nat_", "s_nationkey"), unique=True)),
        (lambda: t.orders, key("ord_", "o_orderkey"), Attr("placed_by", key("cust_", "o_custkey"), unique=True)),
        (lambda: t.orders, key("ord_", "o_orderkey"),
         Attr("total_price", F.round(F.col("o_totalprice") * 100).cast("bigint"), "literal", "integer", unique=True)),
        (lambda: t.orders, key("ord_", "o_orderkey"),
         Attr("order_date", _date_str("o_orderdate"), "literal", "date", unique=True)),
        (lambda: t.orders, key("ord_", "o_orderkey"), Attr("status", F.col("o_orderstatus"), "literal", unique=True)),
        (lambda: t.lineitem, key("ord_", "l_orderkey"), Attr("contains", key("part_", "l_partkey"))),
        (lambda: t.lineitem, key("part_", "l_partkey"), Attr("supplied_by", key("supp_", "l_suppkey"))),
        (lambda: t.part, key("part_", "p_partkey"), Attr("label", F.col("p_name"), "literal", lang=lang, unique=True)),
        (first, cust, Attr("active.from", _date_str("d"), "literal", "date", unique=True)),
        (last, cust, Attr("active.to", _date_str("d"), "literal", "date", unique=True)),
    ]
    out: dict[str, list] = {}
    for src, subject, attr in specs:
        out.setdefault(attr.p, []).append(
            lambda src=src, subject=subject, attr=attr: to_triples(src(), subject, [attr]))
    return out


def kg_triples(t: Tables) -> DataFrame:
    """F1 as one DataFrame (every branch)."""
    return union_triples([b() for bs in kg_sources(t).values() for b in bs])


def _cycle(idx_col) -> "F.Column":
    return F.element_at(F.array(*[F.lit(r) for r in F2_RELATION_CYCLE]), (idx_col % 10 + 1).cast("int"))


def _inverse_of(rel) -> "F.Column":
    m = F.create_map(*[F.lit(x) for a, b in INVERSE_PAIRS for x in (a, b, b, a)])
    return F.element_at(m, rel)


def qa_forms(t: Tables) -> DataFrame:
    """one question / gold logical form / raw model output per part.

    The gold constrains a Document by the part's name through a relation
    picked by the part key; larger parts (size > 25) add a second constraint
    on their type, so the alias expansion sees one- and two-relation forms.
    The raw prediction cycles through six kinds by key: exact, surplus
    `` ) )``, braces, inverse-relation swap, list wrapper with a chat marker,
    wrong relation.
    """
    p = spread(t.part.select(F.col("p_partkey").alias("idx"), F.col("p_name").alias("m"),
                             F.lower("p_type").alias("ty"), "p_size"))
    r = _cycle(F.col("idx"))
    rw = _cycle(F.col("idx") + 3)
    two = F.col("p_size") > 25
    tail = F.when(two, F.concat(F.lit(" ( JOIN [ issued_by ] [ "), F.col("ty"), F.lit(" ] )"))).otherwise(F.lit(""))

    def form(join):
        return F.when(two, F.concat(F.lit("( AND [ Document ] ( AND "), join, tail, F.lit(" ) )"))) \
                .otherwise(F.concat(F.lit("( AND [ Document ] "), join, F.lit(" )")))

    gold = form(F.concat(F.lit("( JOIN ( R [ "), r, F.lit(" ] ) [ "), F.col("m"), F.lit(" ] )")))
    swap = form(F.concat(F.lit("( JOIN [ "), _inverse_of(r), F.lit(" ] [ "), F.col("m"), F.lit(" ] )")))
    wrong = form(F.concat(F.lit("( JOIN ( R [ "), rw, F.lit(" ] ) [ "), F.col("m"), F.lit(" ] )")))
    k = F.col("idx") % 6
    raw = (F.when(k == 0, gold).when(k == 1, F.concat(gold, F.lit(" ) )")))
           .when(k == 2, F.translate(gold, "[]", "{}")).when(k == 3, swap)
           .when(k == 4, F.concat(F.lit("['user assistant"), gold, F.lit("']")))
           .otherwise(wrong))
    return p.select("idx", F.concat(F.lit("which document covers "), F.col("m"), F.lit("?")).alias("question"),
                    gold.alias("gold"), raw.alias("raw_pred"))


def text_pairs(t: Tables) -> DataFrame:
    """each user turn and the assistant turn that answers it; without one ``pred`` is null, which
    scores as a miss."""
    c = t.conversations
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("gold"))
    a = c.filter(F.col("role") == "assistant").select("conv_id", (F.col("turn") - 1).alias("turn"),
                                                      F.col("text").alias("pred"))
    return u.join(a, ["conv_id", "turn"], "left")


def training_pairs_fixture(t: Tables) -> DataFrame:
    """labelled documents as (input, output) training pairs."""
    d, lab = t.documents, t.labels
    return (d.join(lab, "doc_id").select(
        F.col("doc_id").alias("idx"), F.col("text").alias("input"),
        F.concat(F.lit("quality "), F.col("quality").cast("string"), F.lit(" toxic "),
                 F.col("toxic").cast("string")).alias("output")))


def token_ids(t: Tables) -> DataFrame:
    """per-event token ids with -100 as the masked label."""
    e = t.events
    return e.select("user_id", "event_id",
                    F.when(F.col("value") < 10, F.lit(-100)).otherwise(F.floor("value").cast("int")).alias("token_id"))


def query_graphs(t: Tables) -> tuple[DataFrame, DataFrame]:
    """one query graph per order -- ``qnodes(qid, nid, id, type, question,
    function)`` and ``qedges(qid, src, dst, relation)``.

    The question node is the class Order, joined to a customer-group entity
    (``cust_<custkey mod 5>``) by ``placed_by`` and to the status literal by
    ``status``; urgent orders carry a second, indistinguishable entity node.
    Even and odd order keys number the nodes in opposite orders, so
    equivalent graphs have unequal node ids.
    """
    o = spread(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    even = F.col("o_orderkey") % 2 == 0
    urgent = F.col("o_orderpriority") == "1-URGENT"
    ent = F.concat(F.lit("cust_"), (F.col("o_custkey") % 5).cast("string"))

    def node(n: int, ident, typ: str):
        return F.struct(F.lit(n).alias("n"), ident.alias("id"), F.lit(typ).alias("type"))

    nodes = o.select(F.col("o_orderkey").alias("qid"), even.alias("even"), F.explode(F.concat(
        F.array(node(1, F.lit("Order"), "class"), node(2, ent, "entity"), node(3, F.col("o_orderstatus"), "literal")),
        F.when(urgent, F.array(node(4, ent, "entity"))).otherwise(F.array().cast(
            "array<struct<n:int,id:string,type:string>>")))).alias("k"))
    nid = F.when(F.col("k.n") == 4, F.lit(4)).when(F.col("even"), F.col("k.n")).otherwise(4 - F.col("k.n"))
    qnodes = nodes.select("qid", nid.cast("long").alias("nid"), "k.id", "k.type",
                          (F.col("k.n") == 1).cast("int").alias("question"), F.lit("none").alias("function"))
    cls = F.when(even, F.lit(1)).otherwise(F.lit(3))

    def edge(dst, rel: str):
        return F.struct(dst.cast("long").alias("dst"), F.lit(rel).alias("relation"))

    edges = o.select(F.col("o_orderkey").alias("qid"), cls.cast("long").alias("src"), F.explode(F.concat(
        F.array(edge(F.lit(2), "placed_by"), edge(F.when(even, F.lit(3)).otherwise(F.lit(1)), "status")),
        F.when(urgent, F.array(edge(F.lit(4), "placed_by"))).otherwise(F.array().cast(
            "array<struct<dst:bigint,relation:string>>")))).alias("k"))
    qedges = edges.select("qid", "src", "k.dst", "k.relation")
    return qnodes, qedges
