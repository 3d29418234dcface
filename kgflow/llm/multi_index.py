"""Op 3: approximate nearest neighbours by an inverted multi-index.

1. Equal vectors become one entry with its ``k`` + 1 smallest ids -- more can't be among any
   query's k nearest, so nothing is lost and a vector with a third of all rows is one entry.
2. A bounded sample of the entries (``SAMPLE`` distinct vectors, smallest hashes; copies don't weigh) trains ``K`` centroids for each
   half of the vector (Lloyd, numpy, on the driver).  Every entry is indexed: its cell is the pair of its halves' nearest centroids.
3. A query walks centroid pairs by rising summed distance with a heap until the cells
   passed hold ``SHARE`` of all entries (at least ``MIN_CANDIDATES``).
4. The inverted lists of one first-half centroid form a region.  A query goes once to each region that
   it probes, with the second-half centroids it wants there.  A region of many entries or
   queries is cut by hash into parts of ``BLOCK`` / ``QUERY_BLOCK`` rows on average, so no task
   holds a whole region.  The entries of the wanted cells are reranked by exact distance in
   double precision; blocks pass on k rows a query, the last step merges them.

Recall at the parameters is stated in the README; ``SHARE`` = 1 is exact.

Cases: rows whose id or vector is null, whose vector is zero, holds a null or a non-finite
component or has another length than most vectors take no part; equal rows (id and vector) count
once; an id with several vectors is that many entries and queries, and none of them is a candidate of a query of the same id; fewer candidates than k give fewer rows; an empty table gives none; other columns
are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgflow.llm.common import staged

K, SAMPLE, ITERATIONS = 64, 16_384, 12
SHARE, MIN_CANDIDATES = 0.5, 2000
BLOCK, QUERY_BLOCK = 8192, 1024


def kmeans(x: np.ndarray, k: int, iterations: int = ITERATIONS, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = np.unique(x, axis=0)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(iterations):
        near = half_distances(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def half_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None])


def walk(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, enough: int) -> list[int]:
    """Cells (i * len(d2) + j) with entries, by rising d1[i] + d2[j], until they hold
    ``enough`` entries."""
    a, b = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    heap, out, held = [(d1[a[0]] + d2[b[0]], 0, 0)], [], 0
    while heap and held < enough:
        _, i, j = heapq.heappop(heap)
        cell = int(a[i] * len(d2) + b[j])
        if counts[cell]:
            out.append(cell)
            held += int(counts[cell])
        if j + 1 < len(b):
            heapq.heappush(heap, (d1[a[i]] + d2[b[j + 1]], i, j + 1))
        if j == 0 and i + 1 < len(a):
            heapq.heappush(heap, (d1[a[i + 1]] + d2[b[0]], i + 1, 0))
    return out


def nearest_in_block(q: np.ndarray, qid: np.ndarray, wanted: list, x: np.ndarray, j: np.ndarray, ids: list, k: int):
    """(query row, id, distance) of each query's k nearest among the block's entries whose
    second-half centroid ``j`` it wants."""
    order = np.argsort(j, kind="stable")
    x, j, ids = x[order], j[order], [ids[i] for i in order]
    for r in range(len(q)):
        ask = np.zeros(int(max(j.max(), max(wanted[r]))) + 1, dtype=bool)
        ask[np.asarray(wanted[r])] = True
        at = np.flatnonzero(ask[j])
        if not len(at):
            continue
        diff = x[at] - q[r]
        d = np.sqrt((diff * diff).sum(axis=1))
        last = min(k, len(d) - 1)                                  # its own vector may be one
        near = np.flatnonzero(d <= np.partition(d, last)[last])
        yield from ((r, m, s) for s, m in sorted((d[i], int(m)) for i in near for m in ids[at[i]] if m != qid[r])[:k])


def search(vectors: DataFrame, is_query: Column, k: int = 10, n_centroids: int = K, share: float = SHARE,
           min_candidates: int = MIN_CANDIDATES, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``is_query``: a condition on the column ``id`` -> ``query_id``, ``rank``, ``vec_id``, ``score``."""
    spark = vectors.sparkSession
    empty = "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull()).where(~bad).where(F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], empty)
    dim = sizes[0].n
    rows = (rows.where(F.size("v") == dim)
            .select("id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(0x5EED), F.col("v")).alias("k2")))
    # the k + 1 smallest ids of each distinct vector; the limit is applied before the shuffle, too
    r = F.dense_rank().over(Window.partitionBy("k1", "k2").orderBy("id"))
    entries = (rows.withColumn("r", r).where(F.col("r") <= k + 1)
               .groupBy("k1", "k2").agg(F.sort_array(F.collect_set("id")).alias("ids"), F.first("v").alias("v")))
    entries = staged(entries, "imi-entries")
    sample = entries.select("k1", "k2", "v").orderBy("k1", "k2").limit(SAMPLE).collect()
    x = np.array([s.v for s in sample])
    h = dim // 2 if dim > 1 else 1
    c1 = kmeans(x[:, :h], n_centroids)
    c2 = kmeans(x[:, h:], n_centroids) if dim > 1 else np.zeros((1, 0))

    @F.pandas_udf("i int, j int")
    def cell(v: pd.Series) -> pd.DataFrame:
        a = np.array(v.tolist()).reshape(-1, dim)
        return pd.DataFrame({"i": half_distances(a[:, :h], c1).argmin(1), "j": half_distances(a[:, h:], c2).argmin(1)})

    index = staged(entries.withColumn("c", cell("v")).select("k1", "ids", "v", "c.i", "c.j"), "imi-index")
    counts = np.zeros((len(c1), len(c2)), dtype=np.int64)
    for row in index.groupBy("i", "j").agg(F.count(F.lit(1)).alias("n")).collect():      # at most K^2 rows
        counts[row.i, row.j] = row.n
    enough = max(min_candidates, int(np.ceil(share * counts.sum())))

    @F.pandas_udf("array<struct<i:int,js:array<int>>>")
    def probes(v: pd.Series) -> pd.Series:
        a, out = np.array(v.tolist()).reshape(-1, dim), []
        for p, q in zip(half_distances(a[:, :h], c1), half_distances(a[:, h:], c2), strict=True):
            regions: dict[int, list[int]] = {}
            for c in walk(p, q, counts.ravel(), enough):
                regions.setdefault(c // len(c2), []).append(c % len(c2))
            out.append([{"i": i, "js": js} for i, js in regions.items()])
        return pd.Series(out)

    queries = rows.where(is_query).dropDuplicates(["id", "k1", "k2"])
    probing = staged(queries.withColumn("probe", F.explode(probes("v"))).select("id", "k1", "v", "probe.i", "probe.js"), "imi-queries")
    asked = {row.i: row.n for row in probing.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}      # at most K rows
    cut = spark.createDataFrame([(i, int(-(-counts[i].sum() // BLOCK)), int(-(-n // QUERY_BLOCK))) for i, n in asked.items()],
                                "i int, parts int, qparts int")
    x_side = (index.join(F.broadcast(cut), "i").withColumn("part", F.pmod("k1", F.col("parts")).cast("int"))
              .select("i", "part", F.explode(F.sequence(F.lit(0), F.col("qparts") - 1)).alias("qpart"), "j", "ids", "v"))
    q_side = (probing.join(F.broadcast(cut), "i").withColumn("qpart", F.pmod(F.xxhash64("id", "k1"), F.col("qparts")).cast("int"))
              .select("i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "qpart", "js", "id", "k1", "v"))

    def block(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(q) and len(x):
            found = list(nearest_in_block(np.array(q["v"].tolist()), q["id"].to_numpy(), q["js"].tolist(), np.array(x["v"].tolist()), x["j"].to_numpy(),
                                          x["ids"].tolist(), k))
        at = [f[0] for f in found]
        return pd.DataFrame({"id": q["id"].to_numpy()[at], "k1": q["k1"].to_numpy()[at], "vec_id": np.array([f[1] for f in found], dtype=np.int64),
                             "score": np.array([f[2] for f in found], dtype=float)}) if at else pd.DataFrame({n: np.zeros(0, t) for n, t in (
                                 ("id", np.int64), ("k1", np.int64), ("vec_id", np.int64), ("score", float))})

    keys = ["i", "part", "qpart"]
    near = q_side.groupBy(*keys).cogroup(x_side.groupBy(*keys)).applyInPandas(block, "id long, k1 long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("id", "k1").orderBy("score", "vec_id"))
    return (near.withColumn("rank", rank).where(F.col("rank") <= k)
            .select(F.col("id").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
