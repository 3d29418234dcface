"""K13 for many instants: which subjects are valid when.

An interval is cut into dyadic blocks of days (block k of level l holds the days k * 2^l to (k + 1) * 2^l - 1): at most two per level,
whatever its length.  Of the blocks that hold an instant there is one per level.  So "start <= instant <= end" is an equi-join on (level, block), without a
bucket width to choose and without a nested loop.  An open end runs to the end of the calendar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgflow.operators.graph import KG, X, end_property

LEVELS = 22                          # 2^22 days from 0001-01-01 pass the year 9999
FIRST_DAY = "0001-01-01"


def day_number(date: Column) -> Column:
    return F.datediff(date, F.lit(FIRST_DAY).cast("date"))


def blocks(lo: Column, hi: Column) -> Column:
    """Dyadic blocks that make up the days ``lo`` to ``hi`` (inclusive): array of (level, block); empty if ``lo`` > ``hi``.

    Level by level, a left end that is the right child of its parent, and a right end that is the left child, are taken."""
    def step(state: Column, level: Column) -> Column:
        a, b, found = state["a"], state["b"], state["found"]
        block = lambda k: F.array(F.struct(level.alias("level"), k.alias("block")))
        none = F.array().cast("array<struct<level:int,block:int>>")
        odd = (a <= b) & (a % 2 == 1)
        a2 = F.when(odd, a + 1).otherwise(a)
        even = (a2 <= b) & (b % 2 == 0)
        b2 = F.when(even, b - 1).otherwise(b)
        more = F.concat(found, F.when(odd, block(a)).otherwise(none), F.when(even, block(b)).otherwise(none))
        go = a2 <= b2
        return F.struct(F.when(go, F.shiftright(a2, 1)).otherwise(F.lit(1)).cast("int").alias("a"), F.when(go, F.shiftright(b2, 1)).otherwise(F.lit(0)).cast("int").alias("b"), more.alias("found"))

    start = F.struct(lo.cast("int").alias("a"), hi.cast("int").alias("b"), F.array().cast("array<struct<level:int,block:int>>").alias("found"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, step, lambda s: s["found"])


def contain(intervals: DataFrame, instants: DataFrame, keep: list[str], at: list[str]) -> DataFrame:
    """``intervals`` (``lo``, ``hi`` days) x ``instants`` (``day``): the columns ``keep`` and ``at`` of the pairs lo <= day <= hi."""
    left = intervals.select(*keep, F.explode(blocks(F.col("lo"), F.col("hi"))).alias("_k")).select(*keep, "_k.level", "_k.block")
    halves = F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda i: F.floor(F.col("day") / F.pow(F.lit(2.0), i)).cast("int"))
    right = instants.select(*at, F.posexplode(halves).alias("level", "block"))
    return left.join(right, ["level", "block"]).select(*at, *keep)


def valid_at(kg: KG, subjects: DataFrame, p_from: str, instants: DataFrame) -> DataFrame:
    """K13 for a batch: ``subjects`` (``x``), ``instants`` (``query_id``, ``at`` date) -> the pairs (``query_id``, ``x``) with
    (no start or some start <= at) and (no end or some end >= at).

    A start that is no date still counts as present and never fits; a null ``at`` fits nobody.  The subjects' starts and ends are grouped once (the earliest start and the latest
    end decide), open ends are the calendar's."""
    start_p, end_p = end_property(p_from)
    xs = subjects.select(X).distinct()
    day = day_number(F.col("o").try_cast("date"))
    sides = [kg.T(p).select(F.col("s").alias(X), F.lit(first).alias("first"), day.alias("day")) for first, p in ((True, start_p), (False, end_p))]
    known = sides[0].unionByName(sides[1]).join(xs, X, "left_semi").groupBy(X).agg(
        F.min(F.when(F.col("first"), F.col("day"))).alias("s"), F.max(F.when(~F.col("first"), F.col("day"))).alias("e"),
        F.max(F.col("first")).alias("has_s"), F.max(~F.col("first")).alias("has_e"))
    # a side without any date that parses is empty: the interval ends before it begins
    lo = F.when(F.coalesce("has_s", F.lit(False)), F.coalesce("s", F.lit(1 << LEVELS))).otherwise(F.lit(0))
    hi = F.when(F.coalesce("has_e", F.lit(False)), F.coalesce("e", F.lit(-1))).otherwise(F.lit((1 << LEVELS) - 1))
    spans = xs.join(known, X, "left").select(X, lo.alias("lo"), hi.alias("hi"))
    when = instants.select("query_id", day_number(F.col("at").cast("date")).alias("day")).where("day is not null").distinct()
    return contain(spans, when, [X], ["query_id"])
