"""Op 8 [native]: mixing sources to target weights by hash-threshold histograms.

Sources in code point order (null last) weigh 1, 2, 3, 1, ... and share all words
by weight; no target exceeds ``max_copies`` times its source's size, the excess is
shared again by weight among the others.

A document is taken floor(target / source size) times, and once more if its
hash lies below its source's threshold (thresholds of the copies are nested: copy k+1 is
taken only where copy k is).  The threshold is found without sorting documents:

1. A narrow table (id, source, size, hash, number) is staged.  The hash is that of the id and text, so
   equal rows share it; the number tells them apart.
2. Level 0 sums words by source and the top ``LEVEL_BITS`` bits of the hash; the bucket in
   which the running sum passes the budget is the boundary.
3. Each further level sums only the boundary bucket's rows by the next bits.  After ``LEVELS`` levels the bucket is one document and
   its copies; ``LEVELS`` more levels on a hash of the number decide how many of them are taken.  They are interchangeable, so reruns take the same rows.
4. The last bucket is taken whole or not, whichever comes nearer to the budget.

Sizes, targets and thresholds have one row per source; running sums see at most
2^LEVEL_BITS rows of a source.  A hot source is summed map-side and filtered row by
row; its rows never meet in one task.

Cases: null or blank text has size 0 (and is taken 0 words); a null source is a source;
a source of size 0 has target 0; null or repeated ids are fine; of equal rows (id and text) as many are taken
as the budget holds; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgflow.llm.common import WORD, fresh, staged, text_or_empty

MAX_COPIES = 3
CYCLE = (1, 2, 3)
LEVEL_BITS, LEVELS = 14, 3


def source_targets(sizes: DataFrame, max_copies: int = MAX_COPIES, cycle=CYCLE) -> DataFrame:
    """``source``, ``source_size`` -> plus ``weight``, ``target`` (double).

    Sharing the excess again and again ends at target = min(max_copies x size, level x weight);
    the level follows from the sources in order of size / weight."""
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source")))
    weight = F.element_at(F.array(*[F.lit(c) for c in cycle]), (F.pmod(rank - 1, F.lit(len(cycle))) + 1).cast("int"))
    s = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_copies)
    by = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    s = (s.withColumn("i", F.row_number().over(by))
         .withColumn("capped", F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
         .withColumn("left", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
         .withColumn("level", (F.sum("source_size").over(everything) - F.col("capped")) / F.col("left").cast("double")))
    # the first source that the level leaves uncapped sets it for all after it
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    s = s.withColumn("at", F.min(F.when(fits, F.col("i"))).over(everything))
    s = s.withColumn("level", F.max(F.when(F.col("i") == F.col("at"), F.col("level"))).over(everything))
    target = F.when(F.col("i") < F.coalesce("at", F.lit(1 << 30)), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight"))
    return s.select("source", "source_size", "weight", target.cast("double").alias("target"))


TOP = (1 << LEVEL_BITS) - 1


def _bucket(level: int):
    """Bits of the hash (of the document, then of the row's number) that name the bucket at a level, as a number."""
    h, at = (F.col("h"), level) if level < LEVELS else (F.col("h2"), level - LEVELS)
    return F.shiftrightunsigned(h, 64 - LEVEL_BITS * (at + 1)).bitwiseAND(TOP)


def _start(h, levels: int):
    """The first ``levels`` x ``LEVEL_BITS`` bits of a hash."""
    return F.shiftrightunsigned(h, 64 - LEVEL_BITS * levels) if levels else F.lit(0).cast("long")


def first_targets(rows: DataFrame, max_copies: int = MAX_COPIES, cycle=CYCLE) -> tuple[DataFrame, DataFrame]:
    """Staged ``source``, ``size``, ``h`` -> the histogram of level 0 and, per source, ``source_size``, ``target``, ``copies`` (of every
    document) and ``budget`` (words to take once more), with empty prefixes."""
    hist = staged(rows.groupBy("source", _bucket(0).alias("b")).agg(F.sum("size").alias("s")), "mix-hist")
    sizes = hist.groupBy("source").agg(F.sum("s").alias("source_size"))
    t = source_targets(sizes, max_copies, cycle)
    ratio = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_copies))).otherwise(F.lit(0))
    t = t.withColumn("copies", ratio.cast("long")).withColumn("budget", F.greatest(F.col("target") - F.col("copies") * F.col("source_size"), F.lit(0.0)))
    zero = F.lit(0).cast("long")
    return hist, staged(t.select("source", "source_size", "target", "copies", "budget", zero.alias("prefix"), zero.alias("prefix2")), "mix-targets")


def _narrowed(state: DataFrame, hist: DataFrame, level: int) -> DataFrame:
    """One level on: the boundary bucket of each source joins its prefix, and what lies below it leaves the budget."""
    run = hist.withColumn("upto", F.sum("s").over(Window.partitionBy("source").orderBy("b")))
    edge = run.join(state.select(F.col("source").alias("src"), "budget"), F.col("source").eqNullSafe(F.col("src")))
    # the first bucket that passes the budget; a source that none passes takes all (prefix beyond the last)
    edge = edge.where("upto > budget").groupBy("source").agg(F.min(F.struct("b", "upto", "s")).alias("e"))
    edge = edge.select(F.col("source").alias("src"), F.col("e.b").alias("b"), (F.col("e.upto") - F.col("e.s")).alias("below"), F.col("e.s").alias("in_bucket"))
    state = state.join(edge, F.col("source").eqNullSafe(F.col("src")), "left")
    # budget 0 lands in the first bucket with words; none: the top bucket's end
    left = F.col("budget") - F.coalesce("below", F.lit(0))
    name = "prefix" if level < LEVELS else "prefix2"
    nxt = F.col(name) * (TOP + 1) + F.coalesce("b", F.lit(TOP))
    if level == 2 * LEVELS - 1:
        nxt = nxt + F.when(F.col("in_bucket").isNull() | (left * 2 > F.col("in_bucket")), F.lit(1)).otherwise(F.lit(0))
    keep = [c for c in ("source", "source_size", "target", "copies", "prefix", "prefix2") if c != name]
    return staged(state.select(*keep, left.alias("budget"), nxt.cast("long").alias(name)), "mix-level")


def _inside(rows: DataFrame, state: DataFrame, level: int) -> DataFrame:
    """Rows in the boundary bucket before ``level``."""
    s = state.select(F.col("source").alias("src"), "prefix", "prefix2")
    inside = rows.join(s, F.col("source").eqNullSafe(F.col("src"))).where(_start(F.col("h"), min(level, LEVELS)) == F.col("prefix"))
    return inside.where(_start(F.col("h2"), level - LEVELS) == F.col("prefix2")) if level > LEVELS else inside


def refined(state: DataFrame, rows: DataFrame, levels: range, hist: DataFrame | None = None) -> DataFrame:
    """``state`` after further levels; ``hist`` is the first one's histogram, if known."""
    for level in levels:
        if hist is None:
            hist = _inside(rows, state, level).groupBy("source", _bucket(level).alias("b")).agg(F.sum("size").alias("s"))
        state, hist = _narrowed(state, hist, level), None
    return state


def slim(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = text_or_empty(docs, text_col)
    return docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"),
                       F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), hash_of(docs, id_col, text_col).alias("h"),
                       F.xxhash64(F.monotonically_increasing_id()).alias("h2"))


def hash_of(docs: DataFrame, id_col: str, text_col: str):
    return F.xxhash64(docs[id_col].cast("string"), F.xxhash64(text_or_empty(docs, text_col)), F.lit(8))


def _copies(base, extra, max_copies: int):
    return F.least(base + F.when(extra, F.lit(1)).otherwise(F.lit(0)), F.lit(max_copies))


def mix(docs: DataFrame, max_copies: int = MAX_COPIES, cycle=CYCLE, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source") -> DataFrame:
    """``id``, ``source``, ``size``, ``source_size``, ``target``, ``copies`` per row."""
    rows = staged(slim(docs, id_col, text_col, source_col), "mix-rows")
    hist, state = first_targets(rows, max_copies, cycle)
    t = refined(state, rows, range(2 * LEVELS), hist).withColumnRenamed("source", "src").withColumnRenamed("copies", "base")
    at = _start(F.col("h"), LEVELS)
    extra = (at < F.col("prefix")) | ((at == F.col("prefix")) & (_start(F.col("h2"), LEVELS) < F.col("prefix2")))
    return (rows.join(t, F.col("source").eqNullSafe(F.col("src")))
            .select("id", "source", "size", "source_size", "target", _copies(F.col("base"), extra, max_copies).alias("copies")))


def mixed(docs: DataFrame, max_copies: int = MAX_COPIES, cycle=CYCLE, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them.  The thresholds, one row a source, meet
    the documents; texts aren't shuffled unless sources are too many to broadcast.  Only the boundary bucket's rows, one document and its copies, are
    staged with their texts, so that their numbers are fixed."""
    src, base, prefix, prefix2, h, h2, n, i = fresh(docs, "_src", "_base", "_prefix", "_prefix2", "_h", "_h2", "_n", "_i")
    rows = staged(slim(docs, id_col, text_col, source_col), "mix-rows")
    hist, state = first_targets(rows, max_copies, cycle)
    state = refined(state, rows, range(LEVELS), hist)

    def with_targets(df: DataFrame, t: DataFrame) -> DataFrame:
        t = t.select(F.col("source").alias(src), F.col("copies").alias(base), F.col("prefix").alias(prefix), F.col("prefix2").alias(prefix2))
        return df.join(t, df[source_col].cast("string").eqNullSafe(F.col(src)))

    keyed = docs.withColumn(h, hash_of(docs, id_col, text_col))
    at = _start(F.col(h), LEVELS)
    plain = with_targets(keyed, state).where(at != F.col(prefix)).withColumn(n, _copies(F.col(base), at < F.col(prefix), max_copies))
    edge = with_targets(keyed, state).where(at == F.col(prefix)).select(*docs.columns, h).withColumn(h2, F.xxhash64(F.monotonically_increasing_id()))
    edge = staged(edge, "mix-edge")
    counted = edge.select(edge[source_col].cast("string").alias("source"), F.regexp_count(text_or_empty(edge, text_col), F.lit(WORD)).cast("long").alias("size"),
                          F.col(h).alias("h"), F.col(h2).alias("h2"))
    last = refined(state, counted, range(LEVELS, 2 * LEVELS))
    some = with_targets(edge, last).withColumn(n, _copies(F.col(base), _start(F.col(h2), LEVELS) < F.col(prefix2), max_copies))
    both = plain.select(*docs.columns, n).unionByName(some.select(*docs.columns, n)).where(F.col(n) > 0)
    return both.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)
