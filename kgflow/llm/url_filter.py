"""Op 7 [native]: URL rules behind a blocked Bloom filter.

A rule is (host, path, verdict); it fits its host and all subdomains, where the url's
path starts with the rule's; the longest fitting rule decides, ties by text.

1. Every rule's canonical form ``host + path`` sets bits in a blocked Bloom filter: one hash picks
   the block, eight bits of a second one are set in its four 64-bit words.  The
   filter is a table of at most ``max_blocks`` rows (32 bytes each).
2. Every distinct (host, path) of the pages yields its candidates -- each
   host suffix with each path prefix of a length that some rule has -- and they probe the
   filter by an equi-join on the block and a mask test.
3. Possible hits meet the rules in an exact equi-join, which removes false positives.
4. The best rule per (host, path) joins back to the pages.  Verdict: the rule's, else
   ``default``.

Only DataFrame functions; the filter is broadcast, bounded by ``max_blocks``; all other joins
are left to the planner, so a long list of rules shuffles.

Cases: a null url or one without ``://`` has an empty host and path and no rule (unless one
names the empty host); repeated rows are all judged; an empty table or rule list works; other
columns are ignored.  A rule given twice with different verdicts: block wins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgflow.llm.common import ascii_lower

MAX_BLOCKS = 1 << 16
BITS_PER_RULE = 16


def host_path(df: DataFrame, url_col: str = "url"):
    """Columns host and path of a url."""
    url = df[url_col].cast("string")
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://(.*)", 1), F.lit(""))      # no match: empty
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host.alias("host"), path.alias("path")


def _mask(key, word: int):
    """Two bits of word 0..3, from a second hash of the key."""
    h = F.xxhash64(F.lit(17 + word), key)
    one = F.lit(1).cast("long")
    lo = F.pmod(h, F.lit(64)).cast("int")
    hi = F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int")
    return F.call_function("shiftleft", one, lo).bitwiseOR(F.call_function("shiftleft", one, hi))


def bloom_blocks(keys: DataFrame, n_blocks: int) -> DataFrame:
    """``key`` -> ``block``, ``w0``..``w3``."""
    return (keys.select(F.pmod(F.xxhash64("key"), F.lit(n_blocks)).alias("block"), *[_mask(F.col("key"), w).alias(f"w{w}") for w in range(4)])
            .groupBy("block").agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(4)]))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", max_blocks: int = MAX_BLOCKS,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``rules``: host, path, verdict -> ``id``, ``host``, ``path``, ``rule``, ``verdict``."""
    rules = (rules.select(ascii_lower(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
             .where("rule_host is not null and verdict is not null")
             .groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))          # 'block' > 'allow'
             .withColumn("key", F.concat("rule_host", F.lit("\x00"), "rule_path")))
    # one number per rule and distinct path length: bounded by the longest url
    seen = rules.agg(F.count(F.lit(1)).alias("n"), F.collect_set(F.char_length("rule_path")).alias("lengths")).first()
    n_blocks = min(max_blocks, max(1, -(-seen.n * BITS_PER_RULE // 256)))
    lengths = F.array(*[F.lit(x) for x in sorted(seen.lengths)]) if seen.lengths else F.expr("cast(array() as array<int>)")
    urls = pages.select(pages[id_col].alias("id"), *host_path(pages, url_col))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    cand = (urls.select("host", "path").distinct()
            .select("host", "path", F.explode(suffixes).alias("rule_host"))
            .select("host", "path", "rule_host", F.explode(prefixes).alias("rule_path"))
            .withColumn("key", F.concat("rule_host", F.lit("\x00"), "rule_path")))
    bloom = bloom_blocks(rules, n_blocks)
    hit = cand.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(n_blocks))).join(F.broadcast(bloom), "block")
    for w in range(4):
        hit = hit.where(F.col(f"w{w}").bitwiseAND(_mask(F.col("key"), w)) == _mask(F.col("key"), w))
    exact = hit.select("host", "path", "rule_host", "rule_path").join(rules.drop("key"), ["rule_host", "rule_path"])
    name = F.concat("rule_host", "rule_path")
    best = (exact.groupBy("host", "path")
            .agg(F.max(F.struct(F.char_length(name).alias("n"), name.alias("rule"), F.col("verdict").alias("verdict"))).alias("b"))
            .select("host", "path", "b.rule", "b.verdict"))
    return (urls.join(best, ["host", "path"], "left")
            .select("id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))
