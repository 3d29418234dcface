"""Op 10: SimHash near-duplicates by tiled exact comparison.

Fingerprint: words ``[^\\x20\\x09-\\x0D]+`` of the A-Z lower-cased text, shingles of
``shingle`` words (fewer words: the whole sequence; none: fingerprint zero), XXH64 with
seed 42 of each, repeats included; a bit is set if set in over half of the hashes.
Fingerprints link at ``radius`` or fewer differing bits.

1. Fingerprints are made in one pass over the texts (Arrow batches) and staged; from here
   on only (doc_id, fingerprint) moves.
2. Equal fingerprints become one row (map-side combined), so copies cost nothing more.
3. Fingerprints are dealt to bands by population count p -- split by a hash into as many
   bands as keep each near ``band`` rows, by the measured counts -- and every band meets the
   bands of p to p + radius: others differ by more than the radius.  In a task the two bands are
   ordered by the population counts of their four 16-bit words and cut into tiles;
   a pair of tiles whose counts differ by more than the radius in sum is skipped, the others are
   compared by exclusive-or and bit counts.  A task holds two bands.
4. A task returns not its links but a forest that connects the same fingerprints
   (union-find), so a large group of near copies gives as many rows as members, not pairs.
5. Components: large-star / small-star rounds over fingerprints, each staged, until
   nothing changes; then documents join their fingerprint's component (AQE splits a hot one).

The comparison is exact, so its work grows with the square of the number of distinct
fingerprints over the bands that remain; memory and rows per task do not.

Cases: null and blank texts have fingerprint zero and link like any other; null ids
are ignored in ``component_id`` (null if a component has no other); repeated rows are
returned as often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgflow.llm.common import fresh, key128, partitions, staged, text_or_empty

SHINGLE, RADIUS, SEED = 4, 4, 42
BAND, TILE = 32_768, 256


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    words = text.encode("utf-8", "surrogatepass").lower().split()      # bytes: A-Z and ASCII space only
    if not words:
        return 0
    n, joined = len(words), b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=n) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    k = min(shingle, n)
    h, counts, done = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), 0
    lo, hi = starts[:n - k + 1].tolist(), ends[k - 1:].tolist()
    while done < len(lo):                       # blocks: a huge text needs no 64 columns of all its shingles
        part = [h(joined[a:b], SEED) for a, b in zip(lo[done:done + 65536], hi[done:done + 65536], strict=True)]
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
        done += len(part)
    return int(np.packbits(counts * 2 > len(lo), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``k1``, ``k2`` (text key), ``fp`` (long, the 64 bits) per row."""
    text = text_or_empty(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), *key128(text), text.alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known: dict[str, int] = {}          # copies within a batch
            for t in pdf["t"]:
                if t not in known:
                    known[t] = fingerprint(t, shingle)
            yield pdf[["id", "k1", "k2"]].assign(fp= np.array([known[t] for t in pdf["t"]], dtype=np.uint64).view(np.int64))
    return rows.mapInPandas(run, rows.select("id").schema.simpleString()[7:-1] + ",k1 long,k2 long,fp long")


def _tiles(fps: np.ndarray):
    """Fingerprints ordered by the population counts of their words, cut into tiles:
    the order, and each tile's least and greatest count per word."""
    pops = np.bitwise_count(fps.view("<u2").reshape(-1, 4)).astype(np.int16)
    order = np.lexsort(pops.T[::-1])
    pops = pops[order]
    starts = np.arange(0, len(fps), TILE)
    return fps[order], starts, np.minimum.reduceat(pops, starts), np.maximum.reduceat(pops, starts)


def close_pairs(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Arrays of fingerprints within ``radius`` bits, one from each side (uint64)."""
    if not len(a) or not len(b):
        return
    a, at, alo, ahi = _tiles(a)
    b, bt, blo, bhi = (a, at, alo, ahi) if same else _tiles(b)
    for i, s in enumerate(at):
        gap = np.maximum(0, np.maximum(blo - ahi[i], alo[i] - bhi)).sum(axis=1)
        x = a[s:s + TILE, None]
        for j in np.flatnonzero(gap <= radius):
            if same and j < i:
                continue
            y = b[bt[j]:bt[j] + TILE]
            p, q = np.nonzero(np.bitwise_count(x ^ y) <= radius)
            if same and j == i:
                p, q = p[p < q], q[p < q]
            if len(p):
                yield x[p, 0], y[q]


class Forest:
    """Union-find over fingerprints; the smaller root wins."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int):
        x, y = self.root(x), self.root(y)
        if x != y:
            lo, hi = (x, y) if x < y else (y, x)
            self.up[hi] = lo
            self.up.setdefault(lo, lo)

    def edges(self):
        return [(x, self.root(x)) for x in list(self.up) if self.root(x) != x]


def links(fps: DataFrame, radius: int = RADIUS, band: int = BAND) -> DataFrame:
    """Distinct ``fp`` -> a forest of links ``u``, ``v`` (u > v) that connects exactly what links of
    ``radius`` bits connect."""
    spark = fps.sparkSession
    fps = fps.withColumn("p", F.bit_count("fp"))
    counts = {r.p: r.n for r in fps.groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}      # 65 rows at most
    if not counts:
        return spark.createDataFrame([], "u long, v long")
    parts = F.create_map(*[F.lit(x) for p, n in counts.items() for x in (p, -(-n // band))])     # bands of a count
    own = fps.withColumn("b", F.pmod(F.xxhash64("fp"), parts[F.col("p")].cast("long")).cast("int"))

    def bands_of(c):
        return F.explode(F.sequence(F.lit(0), parts[F.col(c)] - 1))

    up = F.explode(F.sequence(F.col("p"), F.least(F.col("p") + radius, F.lit(64))))
    down = F.explode(F.sequence(F.greatest(F.col("p") - radius, F.lit(0)), F.col("p")))
    left = (own.select("fp", "p", F.col("b").alias("i"), up.alias("q")).where(parts[F.col("q")].isNotNull())
            .select("p", "i", "q", bands_of("q").alias("j"), "fp", F.lit(0).alias("side")).where("q > p or j >= i"))
    right = (own.select("fp", F.col("p").alias("q"), F.col("b").alias("j"), down.alias("p")).where(parts[F.col("p")].isNotNull())
             .select("p", bands_of("p").alias("i"), "q", "j", "fp", F.lit(1).alias("side")).where("p < q or i < j"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Forest()
        fp, side = pdf["fp"].to_numpy().view(np.uint64), pdf["side"].to_numpy()
        r = pdf.iloc[0]
        same = r["p"] == r["q"] and r["i"] == r["j"]
        for x, y in close_pairs(fp[side == 0], fp[side == 1], radius, False) if not same else close_pairs(fp, fp, radius, True):
            for u, v in zip(x.view(np.int64).tolist(), y.view(np.int64).tolist(), strict=True):
                f.join(u, v)
        return pd.DataFrame(f.edges(), columns=["u", "v"], dtype=np.int64)

    keys = ["p", "i", "q", "j"]        # an exchange of few bytes and much work: its tasks must not be merged by size
    return left.unionByName(right).repartition(partitions(spark), *keys).groupBy(*keys).applyInPandas(compare, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``u``, ``v`` -> ``node``, ``root`` (the least node of its component) for every
    node of an edge; rounds of large-star and small-star, staged."""
    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else \
            e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        if large:       # neighbours above u hang on the least of u and its neighbours
            out = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:           # u and its smaller neighbours hang on the least of them
            out = both.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                                               F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        return out.where("u <> v").distinct()

    def state(e: DataFrame):
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return r[0], r[1]

    e = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "simhash-edges")
    was = state(e)
    while was[0]:
        e = staged(star(star(e, True), False), "simhash-edges")
        if (now := state(e)) == was:
            break
        was = now
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, band: int = BAND,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``k1``, ``k2``, ``fp``, ``root`` (the component, also of null ids), ``component_id`` per row;
    see the module."""
    rows = staged(fingerprints(docs, shingle, id_col, text_col), "simhash-rows")
    classes = staged(rows.groupBy("fp").agg(F.min("id").alias("low")), "simhash-classes")
    comp = components(links(classes.select("fp"), radius, band))
    known = classes.join(comp, classes.fp == comp.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = known.groupBy("root").agg(F.min("low").alias("component_id"))
    # at most one row per distinct fingerprint, staged: the planner sees its size
    label = staged(known.join(least, "root").select("fp", "root", "component_id"), "simhash-labels")
    return rows.join(label, "fp").select("id", "k1", "k2", "fp", "root", "component_id")


WORDS = 1 << 16                      # 64-bit words of the filter of keys: 512 KB


def _mask(k2) -> Column:
    """Two bits of a key's word."""
    def bit(n: int) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(k2, n).bitwiseAND(63).cast("int"))
    return bit(0).bitwiseOR(bit(6))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component does: the smallest id's (null
    last; then by text key), one row of equal rows.

    Most rows are the only one of their component.  A filter of fixed size over the keys of all others (no texts) lets them pass where they are; only
    rows that it may hold are written out and meet those keys exactly: an anti-join for what passed by chance, and one row for each document that
    stays in its group's place."""
    i, a, b, h1, h2, w, bits = fresh(docs, "_id", "_k1", "_k2", "_h1", "_h2", "_w", "_bits")
    marks = near_duplicates(docs, shingle, radius, id_col=id_col, text_col=text_col)
    first = F.min(F.struct(F.col("id").isNull().alias("n"), "id", "k1", "k2"))
    several = marks.groupBy("root").agg(F.count(F.lit(1)).alias("c"), first.alias("s")).where("c > 1").select(F.col("root").alias("r"), "s")
    keys = marks.join(several, marks.root == F.col("r")).select("id", "k1", "k2", (F.col("s.id").eqNullSafe(F.col("id")) & (F.col("s.k1") == F.col("k1")) & (F.col("s.k2") == F.col("k2"))).alias("first"))
    keys = staged(keys.groupBy("id", "k1", "k2").agg(F.bool_or("first").alias("first")).select(F.col("id").alias(i), F.col("k1").alias(a), F.col("k2").alias(b), "first"), "simhash-groups")
    k1, k2 = key128(text_or_empty(docs, text_col))
    keyed = docs.withColumns({h1: k1, h2: k2})
    # at most WORDS rows
    held = keys.groupBy(F.pmod(F.col(a), F.lit(WORDS)).alias(w)).agg(F.bit_or(_mask(F.col(b))).alias(bits))
    tested = keyed.join(F.broadcast(held), F.pmod(F.col(h1), F.lit(WORDS)) == F.col(w), "left")
    maybe = F.coalesce(F.col(bits).bitwiseAND(_mask(F.col(h2))) == _mask(F.col(h2)), F.lit(False))
    rest = staged(tested.where(maybe).select(*docs.columns, h1, h2), "simhash-rest")

    def same(k: DataFrame):
        return (rest[h1] == k[a]) & (rest[h2] == k[b]) & rest[id_col].eqNullSafe(k[i])

    alone = rest.join(keys, same(keys), "left_anti")
    stay = keys.where("first")
    picked = rest.join(stay, same(stay), "left_semi").dropDuplicates([id_col, h1, h2])
    return tested.where(~maybe).select(*docs.columns).unionByName(alone.unionByName(picked).select(*docs.columns))
