"""Op 1: best-fit-decreasing bin packing of indivisible groups into shards.

``assign_shards`` keeps all rows of a group (equal texts; null counts as the
empty text) in one shard and makes the shards' sizes near equal.

1. A narrow table (id, size, checksum, 128-bit text key) is staged; no text
   moves after that.
2. ``groupBy`` on the key gives one row per group; map-side combination makes a
   group with a third of all rows cheap.
3. Every partition runs best-fit decreasing over its own groups, sorted by Spark
   (spilling) and streamed: a group enters the fullest bin that still has room
   for it, found in a balanced tree of remaining capacities, or opens a new one.
   Bins have the fixed capacity total / (shards x cells); a larger group gets a
   bin of its own.  A task's state is its bins, not its groups.
4. The bins -- at most 2 x shards x cells plus one per partition, however many
   rows there are -- are packed into the shards by the same tree on the driver,
   at the least capacity that needs no more shards than asked for.
5. Rows meet their group's shard in an equi-join (AQE splits a hot group) and are
   numbered per (shard, hash cell) plus the cells' offsets, so no task ever sees
   a whole shard.

Cases: null text has 0 bytes and checksum 0 and joins the group of the empty text;
null or repeated ids and repeated rows all get their own slots; an empty table gives
no rows; other columns are ignored.  A group above the shard size stays whole and
fills a shard alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgflow.llm.common import key128, partitions, staged, text_or_empty

N_SHARDS = 24
CELLS = 128            # first-level bins per shard
ROW_OVERHEAD = 8


class CapacityTree:
    """Treap over (remaining capacity, bin): insert, remove, tightest fit, all in
    logarithmic expected time.  Priorities are a hash of the key, so a rerun builds
    the same tree."""

    def __init__(self):
        self.root = None

    @staticmethod
    def _prio(key):
        return ((key[0] * 0x9E3779B97F4A7C15) ^ ((key[1] + 1) * 0xC2B2AE3D27D4EB4F)) * 0xD6E8FEB86659FD93 >> 7 & 0xFFFFFFFF

    def _split(self, node, key):
        """Nodes below ``key`` and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] >= b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def insert(self, key):
        left, right = self._split(self.root, key)
        self.root = self._merge(self._merge(left, [key, self._prio(key), None, None]), right)

    def pop_tightest(self, size):
        """Remove and return the smallest key with remaining capacity >= size."""
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node, node[2]
            else:
                node = node[3]
        if best is None:
            return None
        key = best[0]
        left, right = self._split(self.root, key)
        _, right = self._split(right, (key[0], key[1] + 1))
        self.root = self._merge(left, right)
        return key


class BestFit:
    """Bins of one capacity; sizes must come in decreasing order."""

    def __init__(self, capacity: int):
        self.capacity, self.tree, self.bins = capacity, CapacityTree(), 0

    def place(self, size: int) -> int:
        found = self.tree.pop_tightest(size)
        if found is None:
            found = (self.capacity, self.bins)
            self.bins += 1
        if found[0] > size:
            self.tree.insert((found[0] - size, found[1]))
        return found[1]


def pack(sizes: list[int], capacity: int) -> list[int]:
    """Bin of each size (decreasing) at a fixed capacity; a larger size is alone."""
    fit = BestFit(capacity)
    return [fit.place(s) for s in sizes]


def pack_into(sizes: list[int], n: int) -> list[int]:
    """Bins 0..n-1 of the sizes (decreasing) at about the least feasible capacity."""
    if not sizes:
        return []
    rest, over = sum(sizes), 0
    while over < min(n - 1, len(sizes)) and sizes[over] * (n - over) > rest:
        rest, over = rest - sizes[over], over + 1     # alone in a shard whatever the capacity
    low = max(1, -(-rest // (n - over)))
    step, good = 0, None
    while good is None:
        cap = low + step
        bins = pack(sizes, cap)
        if max(bins) < n:
            good, high = bins, cap
        else:
            low, step = cap, max(1, low >> 12, step * 2)
    while high - low > max(1, high >> 14):
        mid = (low + high) // 2
        bins = pack(sizes, mid)
        if max(bins) < n:
            good, high = bins, mid
        else:
            low = mid
    return good


def best_fit_bins(groups: DataFrame, keys: list[str], size: str, capacity: int) -> DataFrame:
    """``keys``, ``size`` -> plus ``part`` and ``bin``: best-fit-decreasing bins of
    ``capacity`` within each hash partition of the groups."""
    spark = groups.sparkSession
    out = groups.select(*keys, size).schema.simpleString()[7:-1]
    cols = [*keys, size]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, fit = TaskContext.get().partitionId(), BestFit(capacity)
        for pdf in batches:
            yield pdf.assign(part=part, bin=[fit.place(s) for s in pdf[size].tolist()])

    dealt = groups.select(*cols).repartition(partitions(spark), *keys).sortWithinPartitions(F.desc(size), *keys)
    return dealt.mapInPandas(run, f"{out},part int,bin int")


def assign_shards(docs: DataFrame, n_shards: int = N_SHARDS, cells: int = CELLS,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``size``, ``text_crc32``, ``shard``, ``slot`` per row; see the module."""
    spark = docs.sparkSession
    text = text_or_empty(docs, text_col)
    slim = staged(docs.select(docs[id_col].alias("id"), (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
                              F.crc32(text).alias("text_crc32"), *key128(text)), "shard-rows")
    groups = slim.groupBy("k1", "k2").agg(F.sum("size").alias("gsize"))
    total = slim.agg(F.sum("size")).first()[0] or 0
    binned = staged(best_fit_bins(groups, ["k1", "k2"], "gsize", max(1, -(-total // (n_shards * cells)))), "shard-groups")
    bins = binned.groupBy("part", "bin").agg(F.sum("gsize").alias("s")).collect()     # bounded, see 4.
    bins.sort(key=lambda r: (-r.s, r.part, r.bin))
    shards = pack_into([r.s for r in bins], n_shards)
    placed = spark.createDataFrame(pd.DataFrame({"part": [r.part for r in bins], "bin": [r.bin for r in bins], "shard": shards}).astype("int32"),
                                   "part int, bin int, shard int")
    where = binned.join(F.broadcast(placed), ["part", "bin"]).select("k1", "k2", "shard")
    rows = slim.join(where, ["k1", "k2"])
    n_cells = partitions(spark)
    order = ["id", "size", "text_crc32", "k2"]
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("id", "k1"), F.lit(n_cells)).cast("int"))
    counts = rows.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("shard", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).alias("before"))
    numbered = rows.withColumn("r", F.row_number().over(Window.partitionBy("shard", "cell").orderBy(*order)))
    return (numbered.join(F.broadcast(before), ["shard", "cell"])      # at most shards x cells rows
            .select("id", "size", "text_crc32", "shard", (F.col("before") + F.col("r") - 1).cast("long").alias("slot")))
