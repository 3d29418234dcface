"""Op 11: phrase collocations from a weighted de Bruijn graph.

Nodes are the K - 1 words, edges the K words (K = ``max_words``) that follow each other in a piece; everything is per language.

1. A task names words by 64-bit hashes and sums, per chunk, the K-gram that begins at every word; at a piece's end it is filled
   with END (0).  So each word is the beginning of exactly one edge, and edges to END are the piece-end corrections.
2. Edges are dealt by (language, first word, one of ``SALT`` slots of the second), so that a word with a third of all edges
   spreads, and summed.  In the same tasks, without another shuffle, every shorter count is the flow out of its
   node: f(w1..wj) is the sum over all edges and ends that begin with these words.  Only grams found ``min_count`` times and one-word flows leave.
3. Frequent edges are compacted: a node whose one edge in and one edge out carry its whole flow is unary.  Paths of unary nodes are found by
   pointer doubling (rounds ~ log of the longest path, each staged) and become one weighted edge that holds its words, in segments of at most
   ``SEGMENT`` edges.  Inside a path all counts equal its weight; only its two end nodes need their flow looked up.
4. Candidates: the K-grams of the paths, and frequent shorter grams.  A gram goes if a gram one word longer around it has
   ``cover`` percent of its count (a longer one still implies that one); nodes inside a path always go.
5. Every cut of a candidate gets the counts of its two parts by joins with the frequent grams; parts are never rarer than the whole, so all are
   there.  Scores are exact decimals.  Ranks come from a top-k of parts of a language, then of the language.
6. Only the ranked phrases' words are looked up in the texts again.

Counts are exact but for collisions of 64-bit word hashes within a language (about 3e-8 at a million words).

Cases: a null text is empty; a null language is ``und`` (with any named so); repeated rows count each; pieces and texts of any length
are read whole (in slices cut between pieces); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgflow.llm.common import LOWER, UPPER, ascii_lower, staged, text_or_empty

MAX_WORDS, MIN_COUNT, COVER, TOP = 3, 10, 50, 2000
SALT = 16
SEGMENT = 1024
PARTS = 32                           # of a language's candidates
CHUNK = 3 << 19                      # words summed side by side
SLICE = 1 << 20                      # characters split side by side
VOCABULARY = 3 << 17                 # words remembered in a task
UND = "und"
END_CLASS = r".,;:!?\x0A-\x0D"       # fixed value: signs that end a piece
TOKEN = re.compile(rf"[^\x20\x09{END_CLASS}]+|[{END_CLASS}]")
END = re.compile(rf"[{END_CLASS}]")
FOLD = str.maketrans(UPPER, LOWER)


def _hash(text: str) -> int:
    """Spark's xxhash64 of the string."""
    import xxhash
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), 42)
    return (h - (1 << 64) if h >> 63 else h) or 1        # 0 is END


def spark_hash(c: Column) -> Column:
    h = F.xxhash64(c)
    return F.when(h == 0, F.lit(1)).otherwise(h)


def _slices(text: str) -> Iterator[str]:
    """The text in parts of about ``SLICE`` characters, cut at piece ends."""
    at = 0
    while len(text) - at > SLICE:
        m = END.search(text, at + SLICE)
        if not m:
            break
        yield text[at:m.end()]
        at = m.end()
    yield text[at:]


class Vocabulary(dict):
    """Raw word -> number (from 1 on) of its lower-cased form in one language; signs that end a piece are 0."""

    def __init__(self, names: "Names", lang: int):
        super().__init__((c, 0) for c in ".,;:!?\n\x0b\x0c\r")
        self.names, self.lang, self.of = names, lang, {}

    def __missing__(self, raw: str) -> int:
        word = raw.lower() if raw.isascii() else raw.translate(FOLD)
        n = self.of.get(word)
        if n is None:
            n = self.of[word] = len(self.names.words)
            self.names.words.append(_hash(word))
            self.names.langs.append(self.lang)
        self[raw] = n
        return n


class Names:
    """Numbered words of a task (a bounded table): hash and language of each."""

    def __init__(self):
        self.words, self.langs, self.of = [0], [0], {}

    def language(self, lang: int) -> Vocabulary:
        known = self.of.get(lang)
        if known is None:
            known = self.of[lang] = Vocabulary(self, lang)
        return known


class Chunk:
    """Words of many texts and the sums of the K-grams that begin at each."""

    def __init__(self, k: int, names: Names):
        self.k, self.names, self.words, self.parts = k, names, 0, []

    def feed(self, text: str, lang: int) -> None:
        tokens = TOKEN.findall(text)
        self.parts.append(np.fromiter(map(self.names.language(lang).__getitem__, tokens), dtype=np.int32, count=len(tokens)))
        self.parts.append(np.zeros(1, dtype=np.int32))
        self.words += len(tokens)

    def full(self) -> bool:
        return self.words >= CHUNK or len(self.names.words) >= VOCABULARY

    def sums(self) -> dict[str, np.ndarray]:
        """``g``, ``u0`` .., ``c``: the K words from every word on (0 beyond the piece), summed."""
        k = self.k
        a = np.concatenate([*self.parts, np.zeros(k, dtype=np.int32)])
        self.parts = []
        at = np.flatnonzero(a)
        bits = max(len(self.names.words).bit_length(), 1)
        held = 63 // bits                                # words that fit one number
        word = a[at]
        codes, code, live = [], word.astype(np.int64), np.ones(len(at), dtype=bool)
        for j in range(1, k):
            live &= a[at + j] > 0
            word = np.where(live, a[at + j], 0)
            if j % held == 0:
                codes.append(code)
                code = word.astype(np.int64)
            else:
                code = (code << bits) | word
        codes.append(code)
        del a, at, word, live
        if len(codes) == 1:
            code.sort()
            new = np.flatnonzero(np.r_[len(code) > 0, code[1:] != code[:-1]])
            c, codes = np.diff(np.r_[new, len(code)]), [code[new]]
        else:
            order = np.lexsort(codes[::-1])
            codes = [x[order] for x in codes]
            new = np.flatnonzero(np.r_[len(order) > 0, np.logical_or.reduce([x[1:] != x[:-1] for x in codes])])
            c, codes = np.diff(np.r_[new, len(order)]), [x[new] for x in codes]
        names, langs, out = np.array(self.names.words, dtype=np.int64), np.array(self.names.langs, dtype=np.int64), {}
        for j in range(k):
            in_code = min(held, k - j // held * held)
            u = (codes[j // held] >> (bits * (in_code - 1 - j % held))) & ((1 << bits) - 1)
            if j == 0:
                out["g"] = langs[u]
            out[f"u{j}"] = names[u]
        return out | {"c": c.astype(np.int64)}


def edges(rows: DataFrame, k: int) -> DataFrame:
    """``lang`` (hash), ``t`` -> ``g``, ``u0`` .. ``u{k-1}``, ``c``; summed per chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(chunk: Chunk) -> Iterator[pa.RecordBatch]:
            if chunk.words:
                out = chunk.sums()
                for s in range(0, len(out["c"]), 1 << 18):
                    yield pa.RecordBatch.from_pydict({n: pa.array(x[s:s + (1 << 18)]) for n, x in out.items()})

        chunk = Chunk(k, Names())
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist(), strict=True):
                for part in _slices(text):
                    chunk.feed(part, lang)
                    if chunk.full():
                        yield from flush(chunk)
                        chunk = Chunk(k, chunk.names if len(chunk.names.words) < VOCABULARY else Names())
        yield from flush(chunk)
    return rows.mapInArrow(run, "g long, " + "".join(f"u{j} long, " for j in range(k)) + "c long")


def words(rows: DataFrame) -> DataFrame:
    """``lang`` (hash), ``t`` -> ``g``, ``word`` (as written): every word at least once, mostly once a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, set[str]] = {}
        for batch in batches:
            new: dict[int, set[str]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("t").to_pylist(), strict=True):
                fresh = new.setdefault(lang, set())
                for part in _slices(text):
                    fresh.update(TOKEN.findall(part))
            for lang, fresh in new.items():
                old = seen.setdefault(lang, set())
                fresh -= old
                old |= fresh
                yield pa.RecordBatch.from_pydict({"g": pa.array([lang] * len(fresh), pa.int64()), "word": pa.array(list(fresh), pa.string())})
            if sum(map(len, seen.values())) > VOCABULARY:
                seen = {}
    return rows.mapInArrow(run, "g long, word string")


def flows(edge_rows: DataFrame, k: int, min_count: int) -> DataFrame:
    """Counts of all frequent grams of 1 to ``k`` words and of every word: ``g``, ``u0`` .. (null beyond the gram), ``f``."""
    us = [f"u{j}" for j in range(k)]
    rows = edge_rows.withColumn("s", F.pmod(F.xxhash64("u1"), F.lit(SALT)) if k > 1 else F.lit(0)).repartition("g", "u0", "s")
    rows = rows.groupBy("g", "s", *us).agg(F.sum("c").alias("c"))
    for n in range(k, 1, -1):
        # a gram of n words gives its count to its first n - 1; itself it goes on if frequent
        frequent = (F.col("c") >= min_count) & (F.col(us[n - 1]) != 0)
        if n < k:                                        # longer grams go on as they are
            longer = F.col(us[n]).isNotNull()
            up = F.when(longer, F.array(F.lit(False))).when(frequent, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))
        else:
            up = F.when(frequent, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(True)))
        rows = rows.select("g", "s", *us, "c", F.explode(up).alias("up"))
        rows = rows.select("g", "s", *us[:n - 1], *(F.when(~F.col("up"), F.col(u)).alias(u) for u in us[n - 1:]), "c")
        rows = rows.groupBy("g", "s", *us).agg(F.sum("c").alias("c"))
    return rows.groupBy("g", *us).agg(F.sum("c").alias("f"))


def _words(*names: str) -> Column:
    return F.struct(*[F.col(x).alias(f"w{i}") for i, x in enumerate(names)])


def unary_paths(edge: DataFrame, node: DataFrame, us: list[str]) -> DataFrame:
    """``node`` (g and words), ``root`` (first unary node of its path), ``pos`` (0 on) of every unary node."""
    into = edge.groupBy("g", *us[1:]).agg(F.max("f").alias("most_in"))
    out = edge.groupBy("g", *us[:-1]).agg(F.max("f").alias("most_out"))
    into = into.select("g", *[F.col(b).alias(a) for a, b in zip(us, us[1:])], "most_in")
    unary = (node.join(into, ["g", *us[:-1]]).where("most_in = f").join(out, ["g", *us[:-1]]).where("most_out = f").select(_words("g", *us[:-1]).alias("node")))
    unary = staged(unary, "unary-nodes")
    back = edge.select(_words("g", *us[:-1]).alias("prev"), _words("g", *us[1:]).alias("node"))
    at = (unary.join(back, "node").join(unary.select(F.col("node").alias("prev"), F.lit(True).alias("inner")), "prev", "left")
          .select("node", F.when(F.col("inner"), F.col("prev")).otherwise(F.col("node")).alias("root"), F.when(F.col("inner"), 1).otherwise(0).cast("long").alias("pos"),
                  F.col("inner").isNull().alias("done")))
    at = staged(at, "unary-paths")
    while not at.where("not done").isEmpty():
        # every pointer jumps to where the node it points to points
        to = at.select(F.col("node").alias("root"), F.col("root").alias("r"), F.col("pos").alias("p"), F.col("done").alias("d"))
        moved = at.where("not done").join(to, "root").select("node", F.col("r").alias("root"), (F.col("pos") + F.col("p")).alias("pos"), F.col("d").alias("done"))
        at = staged(at.where("done").unionByName(moved), "unary-paths")
    return at.drop("done")


def compacted(edge: DataFrame, paths: DataFrame, us: list[str], segment: int = SEGMENT) -> DataFrame:
    """``g``, ``words`` (array), ``f`` of every compact path, in segments."""
    source = paths.select(F.col("node").alias("n0"), F.col("root").alias("r0"), F.col("pos").alias("p0"))
    target = paths.select(F.col("node").alias("n1"), F.col("root").alias("r1"), F.col("pos").alias("p1"))
    e = (edge.withColumn("n0", _words("g", *us[:-1])).withColumn("n1", _words("g", *us[1:]))
         .join(source, "n0", "left").join(target, "n1", "left"))
    # an edge belongs to the path of its target, else to that of its source, else it is a path of its own
    root = F.coalesce("r1", "r0")
    pos = F.coalesce("p1", F.col("p0") + 1, F.lit(0))
    e = e.select("g", F.coalesce(root, F.col("n0")).alias("root"), F.when(root.isNull(), F.col(us[-1])).alias("own"), pos.alias("pos"),
                 (pos / segment).cast("long").alias("seg"), F.array(*us).alias("ws"), "f")
    per = e.groupBy("g", "root", "own", "seg").agg(F.array_sort(F.collect_list(F.struct("pos", "ws"))).alias("e"), F.first("f").alias("f"))
    words = F.concat(F.slice(F.col("e")[0]["ws"], 1, len(us) - 1), F.transform("e", lambda x: F.element_at(x["ws"], len(us))))
    return per.select("g", words.alias("words"), "f")


def _gram(grams: DataFrame, k: int, n: int) -> DataFrame:
    """Frequent grams of ``n`` words: ``g``, ``u0`` .. ``u{n-1}``, ``f``."""
    at = F.col(f"u{n - 1}").isNotNull()
    return (grams.where(at & F.col(f"u{n}").isNull()) if n < k else grams.where(at)).select("g", *[f"u{j}" for j in range(n)], "f")


def _part(df: DataFrame, grams: DataFrame, k: int, first: int, n: int, out: str) -> DataFrame:
    """With the count of words ``first`` .. ``first + n - 1`` as ``out``."""
    g = _gram(grams, k, n)
    g = g.select("g", *[F.col(f"u{j}").alias(f"u{first + j}") for j in range(n)], F.col("f").alias(out))
    return df.join(g, ["g", *[f"u{first + j}" for j in range(n)]])


def _scored(df: DataFrame, grams: DataFrame, k: int, n: int, known: dict[tuple[int, int], str]) -> DataFrame:
    """Candidates of ``n`` words (``g``, ``u``.., ``a``; ``known`` (first, words) -> column of a part's count) -> ``ws``, ``a``, ``l``, ``r``, ``score``."""
    cuts = []
    for cut in range(1, n):
        sides = []
        for first, size in ((0, cut), (cut, n - cut)):
            col = known.get((first, size))
            if col is None:
                col = f"c{first}_{size}"
                df = _part(df, grams, k, first, size, col)
            sides.append(col)
        big = [F.col(c).cast("decimal(15,0)") for c in ("a", *sides)]
        df = df.withColumn("_n", F.lit(1000000).cast("decimal(7,0)") * (big[0] * big[0])).withColumn("_d", big[1] * big[2])
        cuts.append(f"c_{cut}")
        df = df.withColumn(cuts[-1], F.expr(f"struct(_n div _d as score, {cut} as cut, {sides[0]} as l, {sides[1]} as r)")).drop("_n", "_d")
    low = F.least(*cuts) if len(cuts) > 1 else F.col(cuts[0])
    return df.select("g", F.array(*[f"u{j}" for j in range(n)]).alias("ws"), "a", low.alias("low")).select("g", "ws", "a", "low.l", "low.r", "low.score")


def _windows(paths: DataFrame, grams: DataFrame, k: int) -> DataFrame:
    """The K-grams of compact paths with the counts of their first and last K - 1 words (``left``, ``right``): the
    path's weight inside it, its end nodes' flows at the ends."""
    node = _gram(grams, k, k - 1).select("g", F.array(*[f"u{j}" for j in range(k - 1)]).alias("ws"), "f")
    rows = (paths.withColumnRenamed("f", "a").withColumn("hw", F.slice("words", 1, k - 1)).withColumn("tw", F.slice("words", -(k - 1), k - 1))
            .join(node.select("g", F.col("ws").alias("hw"), F.col("f").alias("head")), ["g", "hw"])
            .join(node.select("g", F.col("ws").alias("tw"), F.col("f").alias("tail")), ["g", "tw"]))
    rows = rows.select("g", "words", "a", "head", "tail", F.explode(F.sequence(F.lit(0), F.size("words") - k)).alias("i"))
    return rows.select("g", *[F.col("words")[F.col("i") + j].alias(f"u{j}") for j in range(k)], "a", F.when(F.col("i") == 0, F.col("head")).otherwise(F.col("a")).alias("left"),
                       F.when(F.col("i") == F.size("words") - k, F.col("tail")).otherwise(F.col("a")).alias("right"))


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, cover: int = COVER, top: int = TOP,
                 text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``: each language's first ``top`` phrases; see the module."""
    k = max_words
    if k < 2 or not 0 < cover <= 100 or min_count < 1:
        raise ValueError("phrases need two words or more, a positive count and a cover of 1 to 100 percent")
    us = [f"u{j}" for j in range(k)]
    lang = F.coalesce(docs[lang_col].cast("string"), F.lit(UND))
    rows = docs.select(lang.alias("lang"), text_or_empty(docs, text_col).alias("t"))
    grams = staged(flows(edges(rows.select(F.xxhash64("lang").alias("lang"), "t"), k), k, min_count), "grams")
    total = grams.where(F.col("u1").isNull()).groupBy("g").agg(F.sum("f").alias("n"))
    common = grams.where(F.col("f") >= min_count)

    edge, node = _gram(common, k, k), _gram(common, k, k - 1)
    paths = unary_paths(edge, node, us)
    compact = staged(compacted(edge, paths, us), "compact-paths")
    longest = _windows(compact, common, k)
    found = _scored(longest, common, k, k, {(0, k - 1): "left", (1, k - 1): "right"})
    for n in range(k - 1, 1, -1):
        cand = _gram(common, k, n)
        if n == k - 1:                                   # nodes inside a path carry nothing else
            inner = paths.select("node.*").toDF("g", *us[:n])
            cand = cand.join(inner, ["g", *us[:n]], "left_anti")
        longer = _gram(common, k, n + 1)
        around = (longer.select("g", *us[:n], "f").unionByName(longer.select("g", *[F.col(us[j + 1]).alias(us[j]) for j in range(n)], "f"))
                  .groupBy("g", *us[:n]).agg(F.max("f").alias("around")))
        cand = cand.join(around, ["g", *us[:n]], "left").where(F.coalesce(F.col("around") * 100 < F.col("f") * cover, F.lit(True)))
        found = found.unionByName(_scored(cand.select("g", *us[:n], F.col("f").alias("a")), common, k, n, {}))

    # ties at the end of the list are decided by the words, so all of them stay until those are known; a language's candidates are ranked in
    # parts first, so that no task sees all of them
    found = found.withColumn("part", F.pmod(F.xxhash64("ws"), F.lit(PARTS)))
    for by in (["g", "part"], ["g"]):
        best = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"))
        found = found.withColumn("rk", F.rank().over(best)).where(F.col("rk") <= top).drop("rk")
    few = staged(found.drop("part"), "collocations")
    return _with_words(few, rows, total, top)


def _with_words(few: DataFrame, rows: DataFrame, total: DataFrame, top: int) -> DataFrame:
    wanted = few.select("g", F.explode("ws").alias("w")).distinct()
    seen = (words(rows.select(F.xxhash64("lang").alias("lang"), "t")).withColumn("word", ascii_lower(F.col("word"))).withColumn("w", spark_hash(F.col("word"))).join(wanted, ["g", "w"], "left_semi").groupBy("g", "w").agg(F.first("word").alias("word")))
    spelt = (few.withColumn("p", F.monotonically_increasing_id()).select("p", "g", "a", "l", "r", "score", F.posexplode("ws").alias("i", "w")).join(seen, ["g", "w"])
             .groupBy("p", "g", "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase")))
    langs = rows.select("lang").distinct().select(F.xxhash64("lang").alias("g"), "lang")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (spelt.join(total, "g").join(langs, "g").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"))

