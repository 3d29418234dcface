"""K23 for cyclic patterns: triangles and four-cycles without their wedges.

A join order through a hub makes a row for each pair of its neighbours.  Here every edge is directed from its end of lower degree to that of higher
degree (ties by name), so that no node has more than sqrt(2 x edges) edges going out, hubs included.

* A triangle is found once, at its lowest node u: the edge u -> v meets the sorted out-lists of u and v, and ``array_intersect`` gives the
  third nodes.  Rows in between are the edges, not the wedges.  An out-list above ``chunk`` nodes is split by a hash into parts, and only the edges at such
  a node are repeated, once a part.
* A four-cycle is found at its highest node v: the two-step paths v - u - w with u and w below v, joined with each other on (v, w).  There
  are at most edges^1.5 of these paths, however large the hubs.

Typed triangles are the same job on nodes marked with their place in the pattern, so that an edge of one relation can't stand for another.  Typed four-cycles
keep the relations apart and know the degrees of heavy nodes only (``_around``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgflow.session import shared_path

CHUNK = 4096
BROADCAST = 1 << 18      # heavy nodes of a place that are sent to all tasks
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _undirected(edges: DataFrame) -> DataFrame:
    """``u``, ``v`` -> distinct edges with ``u`` < ``v``; no loops, no nulls."""
    return (edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())


def directed(edges: DataFrame) -> DataFrame:
    """``u``, ``v`` (undirected, any order, repeats allowed) -> ``u`` -> ``v`` from lower to higher degree, with the degrees ``du``, ``dv``."""
    e = _undirected(edges)
    degree = e.select(F.explode(F.array("u", "v")).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("d"))
    e = (e.join(degree.select(F.col("n").alias("u"), F.col("d").alias("du")), "u")
         .join(degree.select(F.col("n").alias("v"), F.col("d").alias("dv")), "v"))
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    return e.select(F.when(up, F.col("u")).otherwise(F.col("v")).alias("u"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("v"),
                    F.least("du", "dv").alias("du"), F.greatest("du", "dv").alias("dv"))


def _part(c: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(c), parts).cast("int")


def triangles(edges: DataFrame, chunk: int = CHUNK, places: bool = False) -> DataFrame:
    """Simple undirected graph ``u``, ``v`` -> every triangle once: ``a``, ``b``, ``c`` (``a`` its node of lowest degree).  With ``places`` nodes
    begin with their place in a typed pattern (0 to 2), and only triangles over all three are found: an edge meets lists of the third place only."""
    e = directed(edges).select("u", "v")
    e = e.withColumn("kind", _place("v") if places else F.lit(0)).withColumn("asks", 3 - _place("u") - _place("v") if places else F.lit(0))
    # parts of a node's out-list: a power of two, so that the parts of two nodes nest; the nodes with several are at most edges / chunk
    size = e.groupBy("u", "kind").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk)
    split = F.broadcast(size.select(F.col("u").alias("s"), F.col("kind").alias("k"), F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n") / chunk))).cast("int").alias("parts")))

    def parted(rows: DataFrame, node: str, kind: str, name: str) -> DataFrame:
        met = rows.join(split, (F.col(node) == F.col("s")) & (F.col(kind) == F.col("k")), "left")
        return met.select(*rows.columns, F.coalesce("parts", F.lit(1)).alias(name))
    lists = (parted(e, "u", "kind", "parts").groupBy("u", "kind", _part(F.col("v"), F.col("parts")).alias("part"))
             .agg(F.array_sort(F.collect_list("v")).alias("out")))
    # the node at the head of an edge has no list where it is the highest of its neighbourhood: no triangle there
    pairs = parted(parted(e.select("u", "v", "asks"), "u", "asks", "pu"), "v", "asks", "pv")
    pairs = pairs.select("u", "v", "asks", "pu", "pv", F.explode(F.sequence(F.lit(0), F.greatest("pu", "pv") - 1)).alias("part"))
    pairs = pairs.select("u", "v", "asks", F.pmod("part", F.col("pu")).cast("int").alias("a"), F.pmod("part", F.col("pv")).cast("int").alias("b"))
    pairs = (pairs.join(lists.select("u", F.col("kind").alias("asks"), F.col("part").alias("a"), F.col("out").alias("lu")), ["u", "asks", "a"])
             .join(lists.select(F.col("u").alias("v"), F.col("kind").alias("asks"), F.col("part").alias("b"), F.col("out").alias("lv")), ["v", "asks", "b"]))
    third = pairs.select(F.col("u").alias("a"), F.col("v").alias("b"), F.explode(F.array_intersect("lu", "lv")).alias("c"))
    return third


def two_steps(edges: DataFrame) -> DataFrame:
    """``v``, ``u``, ``w``: the paths v - u - w whose end ``v`` is above both others by degree."""
    e = directed(edges)
    low = F.struct(F.col("du").alias("d"), F.col("u").alias("n"))
    high = F.struct(F.col("dv").alias("d"), F.col("v").alias("n"))
    # from u up to v, and from u to any other neighbour w below v
    ups = e.select(F.col("u").alias("m"), high.alias("top"))
    both = ups.unionByName(e.select(F.col("v").alias("m"), low.alias("top"))).select("m", F.col("top").alias("end"))
    paths = ups.join(both, "m").where(F.col("end") < F.col("top"))
    return paths.select(F.col("top.n").alias("v"), F.col("m").alias("u"), F.col("end.n").alias("w"))


def four_cycles(edges: DataFrame) -> DataFrame:
    """Simple undirected graph ``u``, ``v`` -> every four-cycle once: ``v`` (its highest node), ``w`` (the opposite one), ``a`` < ``b``."""
    p = two_steps(edges)
    return (p.select("v", "w", F.col("u").alias("a")).join(p.select("v", "w", F.col("u").alias("b")), ["v", "w"]).where("a < b"))


def _typed_four_cycles(edges: DataFrame, opposite: dict[int, int]) -> DataFrame:
    """``four_cycles`` of nodes that begin with their place (0 to 3), one node a place: ``v`` and ``w`` opposite each other, ``a`` and ``b`` beside them."""
    at = [0, min(opposite.keys() - {0, opposite[0]}), opposite[0], max(opposite.keys() - {0, opposite[0]})]
    e = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    sides = [e.where((_place("u") == at[k]) & (_place("v") == at[(k + 1) % 4])).select(F.col("u").alias("a"), F.col("v").alias("b")) for k in range(4)]
    return _around(sides).select(F.col("x0").alias("v"), F.col("x2").alias("w"), F.col("x1").alias("a"), F.col("x3").alias("b"))


def _around(sides: list[DataFrame]) -> DataFrame:
    """``sides[k]``: ``a``, ``b`` (nodes at places k and k + 1, the last side's ``b`` at place 0; repeats and nulls allowed) -> every cycle once: ``x0`` to ``x3``.

    The sides are written once, as distinct rows, so that what was shuffled to make them can go before the cycles are searched.  Nodes rank by degree, but only
    the heavy ones, whose number is bounded, have their degree: the others have 0 and rank by their place, so no edge is shuffled to learn it.  A cycle is found at
    its highest node v: paths v - u - w with u and w below v meet on (v, w).  A heavy v is on at most sqrt(8 x edges) nodes' paths, and a light one sees light
    nodes only, so there are about edges^1.5 of these paths at most."""
    spark = sides[0].sparkSession
    path = shared_path(spark, "cycles")
    with _files_go(spark):
        for k, side in enumerate(sides):
            side.where("a is not null and b is not null").select("a", "b").distinct().write.parquet(f"{path}/side-{k}")
    r = [spark.read.parquet(f"{path}/side-{k}") for k in range(4)]
    sizes = {x.k: x for x in reduce(DataFrame.unionByName, [x.agg(F.lit(k).alias("k"), F.count(F.lit(1)).alias("n"), F.approx_count_distinct("a").alias("a"),
                                                                 F.approx_count_distinct("b").alias("b")) for k, x in enumerate(r)]).collect()}
    nodes = [max(1, sizes[k].a, sizes[k - 1 if k else 3].b) for k in range(4)]
    ends = [sizes[k].n + sizes[k - 1 if k else 3].n for k in range(4)]
    with _files_go(spark):
        _heavy(r, sum(x.n for x in sizes.values())).write.parquet(f"{path}/heavy")
    heavy = spark.read.parquet(f"{path}/heavy")
    n_heavy = {x.place: x.n for x in heavy.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    # light nodes' paths go through the pair of opposite places with the fewer rows by the usual estimate, to its place of greater degree
    through = [sizes[k].n * sizes[k - 1 if k else 3].n / nodes[k] for k in range(4)]
    ends_at = (0, 2) if through[1] + through[3] <= through[0] + through[2] else (1, 3)
    last = max(ends_at, key=lambda k: ends[k] / nodes[k])
    rank = [(k - last - 1) % 4 for k in range(4)]                          # of light nodes, and among equal degrees: the place chosen is the highest

    def known(rows: DataFrame, column: str, place: int, degree: str, how: str = "left") -> DataFrame:
        """Plus the degree of a heavy node, 0 of others."""
        if not n_heavy.get(place):
            return rows.withColumn(degree, F.lit(0).cast("long"))
        of = heavy.where(F.col("place") == place).select(F.col("node").alias(column), F.col("d").alias(degree))
        of = F.broadcast(of) if n_heavy[place] <= BROADCAST else of
        return rows.join(of, column, how).withColumn(degree, F.coalesce(degree, F.lit(0).cast("long")))

    def side(x: int, y: int) -> DataFrame:
        """Edges between two places beside each other, under these places' names."""
        k, names = (x, ("a", "b")) if (x + 1) % 4 == y else (y, ("b", "a"))
        return r[k].select(F.col(names[0]).alias(f"x{x}"), F.col(names[1]).alias(f"x{y}"))

    def below(x: int, top: int) -> Column:
        return F.col(f"d{x}") <= F.col(f"d{top}") if rank[x] < rank[top] else F.col(f"d{x}") < F.col(f"d{top}")

    def paths(top: int, mid: int, end: int) -> DataFrame:
        up = known(side(top, mid), f"x{top}", top, f"d{top}", "left" if top == last else "inner")
        up = known(up, f"x{mid}", mid, f"d{mid}").where(below(mid, top)).select(f"x{top}", f"x{mid}", f"d{top}")
        on = known(side(mid, end), f"x{end}", end, f"d{end}")
        return up.join(on, f"x{mid}").where(below(end, top)).select(f"x{top}", f"x{mid}", f"x{end}")

    found = []
    for top in range(4):
        if top == last or n_heavy.get(top):                                # a light node elsewhere has a higher one beside it or opposite
            end = (top + 2) % 4
            found.append(paths(top, (top + 1) % 4, end).join(paths(top, (top + 3) % 4, end), [f"x{top}", f"x{end}"]).select("x0", "x1", "x2", "x3"))
    return reduce(DataFrame.unionByName, found)


def _heavy(sides: list[DataFrame], edges: int) -> DataFrame:
    """``place``, ``node``, ``d``: the nodes of more than sqrt(edges / 8) edges, at most sqrt(32 x edges) of them, with their degrees.  Ends are counted by hashes of
    nodes first, so that only nodes of full hashes are counted one by one."""
    least = math.sqrt(edges / 8)
    ends = reduce(DataFrame.unionByName, [x.select(F.lit((k + i) % 4).alias("place"), F.col(c).alias("node")) for k, x in enumerate(sides) for i, c in enumerate("ab")])
    ends = ends.withColumn("h", F.pmod(F.xxhash64("node"), F.lit(1 << max(6, math.ceil(math.log2(16 * least + 1))))))
    full = ends.groupBy("place", "h").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > least).select("place", "h")
    return ends.join(F.broadcast(full), ["place", "h"], "left_semi").groupBy("place", "node").agg(F.count(F.lit(1)).alias("d")).where(F.col("d") > least)


@contextmanager
def _files_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written here go after each write."""
    before = spark.conf.get(CLEANUP_KEY, None)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP_KEY) if before is None else spark.conf.set(CLEANUP_KEY, before)


def _place(node) -> Column:
    return F.substring(node, 1, 1).cast("int")


def _marked(kg, pattern: tuple, place: dict[str, int]) -> DataFrame:
    s, p, o = pattern
    t = kg.T(p).filter(F.col("o_kind") == "iri")
    return t.select(F.concat(F.lit(f"{place[s]}|"), "s").alias("u"), F.concat(F.lit(f"{place[o]}|"), "o").alias("v"))


def _variables(patterns: list[tuple], n: int) -> list[str]:
    names = list(dict.fromkeys(t for s, _, o in patterns for t in (s, o)))
    ends = {frozenset((s, o)) for s, _, o in patterns}
    if len(patterns) != n or len(names) != n or len(ends) != n or not all(t.startswith("?") for t in names):
        raise ValueError(f"a cycle of {n} needs {n} patterns between {n} variables")
    return names


def _edges(kg, patterns: list[tuple], n: int) -> tuple[DataFrame, list[str]]:
    names = _variables(patterns, n)
    return reduce(DataFrame.unionByName, [_marked(kg, p, {x: i for i, x in enumerate(names)}) for p in patterns]), names


def _by_place(nodes: Column, names: list[str]) -> list[Column]:
    """Columns named by the pattern's variables, from an array of marked nodes."""
    at = F.array_sort(nodes)                             # marks are one digit: nodes come in the pattern's order
    return [F.substring(at[i], 3, 1 << 30).alias(x[1:]) for i, x in enumerate(names)]


def match_triangle(kg, patterns: list[tuple], chunk: int = CHUNK) -> DataFrame:
    """K23 for three patterns ``(?a, r, ?b)`` that close a triangle (all terms nodes): one row per match, a column per variable."""
    e, names = _edges(kg, patterns, 3)
    return triangles(e, chunk, places=True).select(*_by_place(F.array("a", "b", "c"), names))


def match_four_cycle(kg, patterns: list[tuple]) -> DataFrame:
    """K23 for four patterns that close a cycle of four variables.  The triples of the patterns are read and written once when this is called (see ``_around``)."""
    names = _variables(patterns, 4)
    beside = {x: [o if s == x else s for s, _, o in patterns if x in (s, o)] for x in names}
    if any(len(v) != 2 for v in beside.values()):
        raise ValueError("the patterns close no cycle")
    ring = [names[0], beside[names[0]][0]]
    while len(ring) < 4:
        ring.append(next(x for x in beside[ring[-1]] if x != ring[-2]))
    side = {frozenset((s, o)): (s, p, o) for s, p, o in patterns}
    sides = []
    for x, y in zip(ring, ring[1:] + ring[:1]):
        s, p, _ = side[frozenset((x, y))]
        t = kg.T(p).filter(F.col("o_kind") == "iri")
        sides.append(t.select(F.col("s" if s == x else "o").alias("a"), F.col("o" if s == x else "s").alias("b")))
    return _around(sides).select(*[F.col(f"x{ring.index(x)}").alias(x[1:]) for x in names])
