"""G operators: equivalent query graphs in a corpus.

The reference decides equivalence of two logical forms by a pairwise graph
isomorphism test.  Over a corpus that would be all pairs; here every graph
gets a canonical certificate instead, and equal certificates are the
equivalence classes -- a group-by, no pairs.

* G2 node labels are hashed, G1 parallel edges bundled.
* G3 colour refinement (1-WL) runs on graphs packed one row per graph
  (grouped once by id), so every round is a row-local expression and no
  round shuffles; the colours are an isomorphism invariant.
* G4: when refinement separates every node of a graph (the usual case for
  query graphs) the colour-labelled edge list *is* canonical and the
  certificate is computed in Spark.  Only graphs with tied colours go to a
  canonical form in Arrow batches (one row per graph, packed by
  id, so a graph is never split).
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNKNOWN = "@@UNKNOWN@@"
SEP = "\u0001"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def comparable(c) -> Column:
    """Forms holding ``@@UNKNOWN@@`` never match anything."""
    return ~F.coalesce(_c(c).contains(UNKNOWN), F.lit(False))


def node_labels(qnodes: DataFrame) -> DataFrame:
    """``qid, nid, label`` -- md5 of id, type, function and time constraint
    (``none`` when absent)."""
    cols = qnodes.columns
    fn = F.coalesce(F.col("function"), F.lit("none")) if "function" in cols else F.lit("none")
    tc = F.coalesce(F.col("tc"), F.lit("none")) if "tc" in cols else F.lit("none")
    part = [F.coalesce(F.col(c).cast("string"), F.lit("none")) for c in ("id", "type")]
    return qnodes.select("qid", "nid", F.md5(F.concat_ws(SEP, *part, fn, tc))
                         .alias("label"))


def edge_bundles(qedges: DataFrame) -> DataFrame:
    """G1: ``qid, src, dst, relations`` with the sorted relation list of the
    parallel edges between a node pair."""
    return qedges.groupBy("qid", "src", "dst").agg(
        F.array_sort(F.collect_list("relation")).alias("relations"))


def with_reverse_edges(qedges: DataFrame, inverse: DataFrame, limit: int = 100000) -> DataFrame:
    """A relation with a known inverse gets the reverse edge too.  The
    inverse table is schema-sized; it is read once and, up to ``limit`` pairs, applied as a
    map literal; a longer one is joined.  A relation may have several inverses."""
    pairs = [(r.p, r.p_inv) for r in inverse.select("p", "p_inv").distinct().limit(limit + 1).collect()]
    base = qedges.select("qid", "src", "dst", "relation")
    if len(pairs) > limit:
        inv = inverse.select(F.col("p").alias("relation"), F.col("p_inv").alias("_to")).distinct()
        flipped = base.join(inv, "relation")
    else:
        to: dict[str, list[str]] = {}
        for a, b in sorted(pairs):
            to.setdefault(a, []).append(b)
        if not to:
            return base.distinct()
        inv = F.create_map(*[x for a, bs in to.items() for x in (F.lit(a), F.array(*[F.lit(b) for b in bs]))])
        flipped = base.filter(F.col("relation").isin(*to)).withColumn("_to", F.explode(F.element_at(inv, F.col("relation"))))
    rev = flipped.select("qid", F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("_to").alias("relation"))
    return base.unionByName(rev).distinct()


def pack(qnodes: DataFrame, qedges: DataFrame) -> DataFrame:
    """One row per graph: ``qid, nodes array<struct<nid, c>>, edges
    array<struct<src, dst, relation>>`` with ``c`` the G2 label.  Nodes and
    edges are unioned and grouped by ``qid`` in one aggregation (one shuffle,
    no join).  A query graph has a handful of nodes, so the row is small."""
    n = node_labels(qnodes).select(
        F.col("qid"), F.lit(True).alias("is_node"), F.col("nid").cast("long").alias("nid"), F.col("label").alias("c"),
        F.lit(None).cast("long").alias("src"), F.lit(None).cast("long").alias("dst"),
        F.lit(None).cast("string").alias("relation"))
    e = qedges.select(
        F.col("qid"), F.lit(False).alias("is_node"), F.lit(None).cast("long").alias("nid"),
        F.lit(None).cast("string").alias("c"), F.col("src").cast("long").alias("src"),
        F.col("dst").cast("long").alias("dst"), F.col("relation"))
    return n.unionByName(e).groupBy("qid").agg(
        F.collect_list(F.when(F.col("is_node"), F.struct("nid", "c"))).alias("nodes"),
        F.collect_list(F.when(~F.col("is_node"), F.struct("src", "dst", "relation"))).alias("edges"))


def _barrier(df: DataFrame) -> DataFrame:
    """A one-to-one generator between rounds: keeps Catalyst from inlining a
    round's colours into the next round's lambdas (which would re-evaluate
    every earlier round once per node reference)."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_r")).select("_r.*")


def _colour_map(nodes: Column) -> Column:
    return F.map_from_arrays(F.transform(nodes, lambda n: n["nid"]), F.transform(nodes, lambda n: n["c"]))


def refine_packed(packed: DataFrame, rounds: int = 3) -> DataFrame:
    """G3 on packed graphs: each round is a row-local expression (no shuffle).
    A node's new colour hashes its colour with the sorted multiset of
    ``(direction, relation, neighbour colour)``."""
    df = packed
    for _ in range(rounds):
        df = _barrier(df.withColumn("_cm", _colour_map(F.col("nodes"))))
        cm, edges = F.col("_cm"), F.col("edges")

        def recolour(n):
            out = F.transform(F.filter(edges, lambda e: e["src"] == n["nid"]),
                              lambda e: F.concat(F.lit(">"), e["relation"], F.lit(":"), F.element_at(cm, e["dst"])))
            inn = F.transform(F.filter(edges, lambda e: e["dst"] == n["nid"]),
                              lambda e: F.concat(F.lit("<"), e["relation"], F.lit(":"), F.element_at(cm, e["src"])))
            sig = F.array_join(F.array_sort(F.concat(out, inn)), ",")
            return F.struct(n["nid"].alias("nid"), F.md5(F.concat(n["c"], F.lit("|"), sig)).alias("c"))

        df = _barrier(df.withColumn("nodes", F.transform(F.col("nodes"), recolour)).drop("_cm"))
    return df


def refine(qnodes: DataFrame, qedges: DataFrame, rounds: int = 3) -> DataFrame:
    """``qid, nid, colour`` after ``rounds`` of colour refinement."""
    r = refine_packed(pack(qnodes, qedges), rounds)
    return r.select("qid", F.explode("nodes").alias("n")).select("qid", F.col("n.nid").alias("nid"),
                                                                 F.col("n.c").alias("colour"))


def _buckets(refined: DataFrame) -> DataFrame:
    cols = F.transform("nodes", lambda n: n["c"])
    return refined.withColumn("bucket", F.md5(F.array_join(F.array_sort(cols), ","))) \
                  .withColumn("discrete", F.size(F.array_distinct(cols)) == F.size(cols))


def wl_buckets(colours: DataFrame) -> DataFrame:
    """``qid, bucket, discrete`` from per-node colours: hash of the sorted
    final colours; ``discrete`` when every node has its own colour."""
    return colours.groupBy("qid").agg(
        F.md5(F.array_join(F.array_sort(F.collect_list("colour")), ",")).alias("bucket"),
        (F.count_distinct("colour") == F.count(F.lit(1))).alias("discrete"))


def wl_buckets_packed(qnodes: DataFrame, qedges: DataFrame, rounds: int = 3) -> DataFrame:
    return _buckets(refine_packed(pack(qnodes, qedges), rounds)).select("qid", "bucket", "discrete")


def _stable(colour: dict, edges: list) -> dict:
    """Colours refined until no class splits any more; a colour is a hash of what it was made of."""
    while True:
        seen: dict = {n: [] for n in colour}
        for s, d, r in edges:
            seen[s].append(f">{r}:{colour[d]}")
            seen[d].append(f"<{r}:{colour[s]}")
        finer = {n: hashlib.md5("|".join([c, *sorted(seen[n])]).encode()).hexdigest() for n, c in colour.items()}
        if len(set(finer.values())) == len(set(colour.values())):
            return colour
        colour = finer


def _components(nodes: list, edges: list) -> list[list]:
    near: dict = {n: [] for n in nodes}
    for s, d, _ in edges:
        near[s].append(d)
        near[d].append(s)
    out, met = [], set()
    for n in nodes:
        if n not in met:
            part, todo = [], [n]
            met.add(n)
            while todo:
                part.append(x := todo.pop())
                todo += (new := set(near[x]) - met)
                met |= new
            out.append(part)
    return out


def _canonical(colour: dict, edges: list) -> str:
    """The same text for isomorphic coloured graphs only.

    After refinement, nodes alone in their class are settled: how the others are tied to them is part of
    the others' colours.  What is left falls into components, canonised one by one.  In a component whose
    colours still tie, a node of the smallest class is singled out and the rest refined again, the least text
    of all choices wins; of nodes that may be swapped without a change, one is tried."""
    colour = _stable(colour, edges)
    of: dict = {}
    for n, c in colour.items():
        of.setdefault(c, []).append(n)
    tied = [n for c in of.values() if len(c) > 1 for n in c]
    shape = ",".join(sorted(colour.values())) + "#" + ";".join(sorted(f"{colour[s]}>{r}>{colour[d]}" for s, d, r in edges))
    loose, parts = set(tied), []
    for part in _components(tied, [e for e in edges if e[0] in loose and e[1] in loose]):
        inside = set(part)
        own = sorted(e for e in edges if e[0] in inside and e[1] in inside)
        mine = {n: colour[n] for n in part}
        if len(set(mine.values())) == len(mine):           # apart now: its colours name its nodes
            parts.append(_canonical(mine, own))
            continue
        sizes: dict = {}
        for n in part:
            sizes.setdefault(mine[n], []).append(n)
        pick = min((c for c in sizes if len(sizes[c]) > 1), key=lambda c: (len(sizes[c]), c))
        tried: list = []
        for n in sizes[pick]:
            if not any(_swappable(n, t, own) for t in tried):
                tried.append(n)
        parts.append(min(_canonical({**mine, n: mine[n] + "*"}, own) for n in tried))
    return shape + "{" + "&".join(sorted(parts)) + "}"


def _swappable(a, b, edges: list) -> bool:
    """Whether exchanging two nodes leaves the (sorted) edges as they are."""
    to = {a: b, b: a}
    return sorted((to.get(s, s), to.get(d, d), r) for s, d, r in edges) == edges


def _exact_certificate(nodes: list[tuple[int, str]], edges: list[tuple[int, int, str]]) -> str:
    return _canonical(dict(nodes), edges)


@F.pandas_udf(T.StringType())
def _tied_certificate(nodes: pd.Series, edges: pd.Series) -> pd.Series:
    """The canonical text's hash of graphs with tied colours; null where ``nodes`` is null."""
    out: list = [None] * len(nodes)
    for i, (ns, es) in enumerate(zip(nodes, edges, strict=True)):
        if ns is not None:
            nd = [(int(n["nid"]), n["c"]) for n in ns]
            ed = [(int(e["src"]), int(e["dst"]), e["relation"]) for e in (es if es is not None else [])]
            out[i] = "x:" + hashlib.md5(_exact_certificate(nd, ed).encode("utf-8")).hexdigest()
    return pd.Series(out, dtype=object)


def certificates(qnodes: DataFrame, qedges: DataFrame, rounds: int = 3) -> DataFrame:
    """``qid, cert``: canonical certificate of every graph (see module doc)."""
    b = _buckets(refine_packed(pack(qnodes, qedges), rounds))
    cm = _colour_map(F.col("nodes"))
    labelled = F.transform("edges", lambda e: F.concat_ws(">", F.element_at(cm, e["src"]), e["relation"],
                                                          F.element_at(cm, e["dst"])))
    discrete_cert = F.concat(F.lit("d:"), F.col("bucket"), F.lit("#"), F.array_join(F.array_sort(labelled), ";"))
    # Discrete graphs: certificate in Spark.  Tied graphs only: exact search in Arrow batches, which get nulls for the others.  One plan for
    # both, so that graphs are packed and refined once.
    tied = _tied_certificate(F.when(~F.col("discrete"), F.col("nodes")), F.when(~F.col("discrete"), F.col("edges")))
    b = b.select(F.col("qid").cast("long").alias("qid"), "discrete", F.when(F.col("discrete"), discrete_cert).alias("d"), tied.alias("x"))
    return b.select("qid", F.when(F.col("discrete"), F.col("d")).otherwise(F.col("x")).alias("cert"))


def equivalent_queries(qnodes: DataFrame, qedges: DataFrame, rounds: int = 3) -> DataFrame:
    """``qid, class_id`` -- the smallest member id names each class."""
    c = certificates(qnodes, qedges, rounds)
    cls = c.groupBy("cert").agg(F.min("qid").alias("class_id"))
    return c.join(cls, "cert").select("qid", "class_id")


def class_sizes(qnodes: DataFrame, qedges: DataFrame, rounds: int = 3) -> DataFrame:
    """G4 summary: ``class_id, size`` in one partial aggregate over the
    certificates (a class holding most graphs costs one counter)."""
    return certificates(qnodes, qedges, rounds).groupBy("cert").agg(
        F.min("qid").alias("class_id"), F.count(F.lit(1)).alias("size")).select("class_id", "size")
