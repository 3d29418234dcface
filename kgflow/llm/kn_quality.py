"""Op 5: quality by an interpolated modified Kneser-Ney model of the words of trusted text.

Units are words (runs of letters, case kept), single digits and single other signs, unfolded in every script and
named by 64-bit hashes; white space parts units, and in scripts without spaces each character is one.  The model grows with
the trusted text and is only ever a Spark table.

1. Trusted documents (labelled quality 1 and not toxic; all of them) are counted: triples of units (starts padded), summed per block of texts in the
   task.  Blocks are dealt to parts by the middle word, so that a part has all that orders 2 and 3 need of its words; words that a bounded sample
   shows to be more than half a part go to several parts by the triple's first word.  A block names its words once and numbers them,
   which takes less room than rows of hashes.
2. A hash of its text puts each document in one of two halves; a document is scored by the model of the trusted
   documents of the other half.  So no document is judged by its own n-grams or its copies', and trusted documents'
   perplexities, which set the thresholds, compare with the others'.
3. Lower orders use continuation counts (distinct left extensions).  What parts don't have themselves comes by joins: order 1 of their words, and the bigrams of words that
   lie in several parts.  A part at rest has its triples' counts; probabilities are made of them where they are asked for.
4. The log probability of a text is a sum over the n-grams and contexts that the model has: the weight of the empty context (a constant of
   each model) for every unit, each seen context's log weight, and for each seen n-gram what its log probability exceeds the lower order's
   by.  Documents' triples are dealt like the trusted ones, meet the model's parts, and come back as sums per block and document.  Beyond a size this is done in
   rounds over the documents, each text in one; a round's shuffle files go before the next (``CLEANUP_KEY``, set for the session unless it says otherwise).
5. Thresholds are quantiles of the trusted documents' perplexity (per unit) within each language
   (``low``, ``high``); languages without trusted documents use those over all.  Documents
   outside are not kept.

Cases: null, empty and white texts have no perplexity and are not kept; a null lang is a language
of its own; unlabelled documents are scored like others; with no trusted text nothing can be judged:
perplexity null, kept if not blank; if all trusted text falls in one half, one model of it scores all; repeated ids or rows
are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgflow.llm.common import bounded_batches, partitions, staged, text_or_empty

WORDS = 3                            # order of the model
LOW, HIGH = 0.001, 0.995
CHUNK = 1 << 20                      # characters cut side by side
BLOCK = 1 << 21                      # places of units in a block
START, END = 1, 2                    # names of the place before a text's first unit and after its last
# fixed value: scripts written without spaces (Thai, Lao, Burmese, Khmer, kana, Han), where each character is a unit
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
UNIT = re.compile(rf"[^\W\d_{UNSPACED}]+|\S")
BLOOM_BITS = 25                      # of the filter of the trusted ids: 4 MB in every task
PART_CHARS = 1 << 24                 # characters a part
ROUNDS, ONE_ROUND = 8, 1 << 26       # of the documents' requests; texts of so few characters take one
SAMPLE = 2000                        # documents from which the most frequent words are known, to deal them to several parts
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
Hot = dict[int, int]


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, the bytes of like weight together."""
    head = np.array([len(arrays), *(v for x in arrays for v in (len(x), ord(x.dtype.char)))], dtype=np.int64).tobytes()
    body = b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes() for x in arrays)
    return len(head + body).to_bytes(8, "little") + pa.compress(head + body, codec="zstd", asbytes=True)


def unpack(data: bytes) -> list[np.ndarray]:
    data = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    k = int.from_bytes(data[:8], "little")
    at, out = 8 + 16 * k, []
    for n, char in np.frombuffer(data, dtype=np.int64, count=2 * k, offset=8).reshape(k, 2).tolist():
        kind = np.dtype(chr(char))
        x = np.frombuffer(data, dtype=np.uint8, count=n * kind.itemsize, offset=at)
        out.append(np.ascontiguousarray(x.reshape(kind.itemsize, n).T).view(kind).reshape(n))
        at += n * kind.itemsize
    return out


def part_of(word: np.ndarray, sub: np.ndarray, parts: int) -> np.ndarray:
    """The part of each middle word, a number of them for the most frequent words."""
    x = word.view(np.uint64) + sub.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(parts)).astype(np.int32)


class Units(dict):
    """Unit -> its number in a block; ``names``: the numbers' 64-bit hashes."""

    def __init__(self) -> None:
        self.names = [START, END]

    def __missing__(self, unit: str) -> int:
        import xxhash
        h = xxhash.xxh64_intdigest(unit.encode("utf-8", "surrogatepass"))
        self[unit] = n = len(self.names)
        self.names.append(h - (1 << 64) if h >> 63 else h)
        return n

    def triples(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each unit, and the end, of each text that has units: the two before it, itself, and its text; and the number of units of every text."""
        rows = [UNIT.findall(t) for t in texts]
        n = np.array([len(r) for r in rows], dtype=np.int64)
        text = np.repeat(np.arange(len(rows)), np.where(n, n + 3, 0))
        place = np.arange(len(text)) - np.repeat((c := np.cumsum(np.where(n, n + 3, 0))) - np.where(n, n + 3, 0), np.where(n, n + 3, 0))
        seq = np.zeros(len(text), dtype=np.int32)
        seq[c[n > 0] - 1] = 1
        real = (place >= 2) & (seq == 0)
        seq[real] = np.fromiter(map(self.__getitem__, chain.from_iterable(rows)), dtype=np.int32, count=int(n.sum()))
        end = np.flatnonzero(place >= 2)
        return seq[end - 2], seq[end - 1], seq[end], text[end].astype(np.int32), n


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, list[np.ndarray], pd.DataFrame]]:
    """The names of a block's words, its triples with their row's number, and its rows (without ``t``, with ``units``)."""
    units, got, rows, held = Units(), [], [], 0

    def block():
        return np.array(units.names, dtype=np.int64), [np.concatenate(x) for x in zip(*got, strict=True)], pd.concat(rows, ignore_index=True)
    for pdf in batches:
        which = (pdf["t"].str.len().cumsum() // CHUNK).to_numpy()
        for _, part in pdf.groupby(which, sort=False):
            a, b, c, text, n = units.triples(part["t"].tolist())
            got.append((a, b, c, text + np.int32(sum(map(len, rows)))))
            rows.append(part.drop(columns="t").assign(units=n))
            held += len(a)
            if held >= BLOCK:
                yield block()
                units, got, rows, held = Units(), [], [], 0
    if rows:
        yield block()


def _dealt(names: np.ndarray, a: np.ndarray, b: np.ndarray, parts: int, hot: Hot) -> Iterator[tuple[int, np.ndarray]]:
    """The parts and the places of their triples, by middle word and first."""
    share = np.array([hot.get(w, 1) for w in names.tolist()], dtype=np.int64)[b]
    sub = np.where(share > 1, names.view(np.uint64)[a] % share.astype(np.uint64), np.uint64(0))
    part = part_of(names[b], sub, parts)
    order = np.lexsort((a, b, part))
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    for x, y in zip(cuts, np.append(cuts[1:], len(order)), strict=True):
        yield int(part[order[x]]), order[x:y]


def _own(names: np.ndarray, *words: np.ndarray) -> list[np.ndarray]:
    """The names that occur, and the words by numbers among those."""
    used = np.zeros(len(names), dtype=bool)
    for w in words:
        used[w] = True
    number = np.cumsum(used, dtype=np.int32) - np.int32(1)
    return [names[used], *(number[w] for w in words)]


def _gaps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x.dtype.type(0))


def frequent(rows: DataFrame, parts: int) -> Hot:
    """Words that are more than half a part, by a bounded sample, and the number of parts that each is dealt to: at most 2 x ``parts`` words."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names, (_, b, _, _), _ in _blocks(batches):
            yield pd.DataFrame({"w": names, "n": np.bincount(b, minlength=len(names))})
    every = F.lit(max(1, rows.count() // SAMPLE))
    counts = rows.where(F.pmod(F.xxhash64("tk"), every) == 0).select("t").mapInPandas(run, "w long, n long").groupBy("w").agg(F.sum("n").alias("n"))
    counts = staged(counts, "kn-words")
    total = counts.agg(F.sum("n")).first()[0] or 1
    return {r.w: math.ceil(2 * parts * r.n / total) for r in counts.where(F.col("n") > F.lit(total / (2 * parts))).collect()}


def word_counts(rows: DataFrame, parts: int, hot: Hot) -> DataFrame:
    """``model``, ``t`` -> ``part``, ``data``: each block's different triples and how often they are there."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for names, (a, b, c, text), docs in _blocks(batches):
            m = docs["model"].to_numpy(dtype=np.int32)[text]
            for part, at in _dealt(names, a, b, parts, hot):
                at = at[c[at] != 1]
                if not len(at):
                    continue
                at = at[np.lexsort((c[at], m[at], a[at], b[at]))]
                first = np.flatnonzero(np.any([np.diff(x[at], prepend=-1) != 0 for x in (a, b, c, m)], axis=0))
                n = np.diff(np.append(first, len(at))).astype(np.int32)
                own, x, y, z = _own(names, a[at[first]], b[at[first]], c[at[first]])
                yield pd.DataFrame({"part": [part], "data": [pack(own, x, _gaps(y), z, m[at[first]].astype(np.int8), n)]})
    return rows.mapInPandas(run, "part int, data binary")


TYPES = "kind int, part int, model int, w long, c long, n long, data binary"


def _types(pdf: pd.DataFrame, hot: Hot) -> Iterator[pd.DataFrame]:
    """A part's triples, summed (kind 0), and what other parts need: in how many bigrams each word ends (kind 1; of frequent words' bigrams (kind 2),
    which lie in several parts, in how many triples each ends), and how many triples (kind 3) and other bigrams (kind 4) are there 1 to 4 times."""
    part, blocks = pdf["part"].iloc[0], [unpack(x) for x in pdf["data"]]
    names = np.unique(np.concatenate([x[0] for x in blocks]))
    v = len(names)
    to = [np.searchsorted(names, x[0]) for x in blocks]
    a, c = (np.concatenate([t[x[i]] for t, x in zip(to, blocks, strict=True)]) for i in (1, 3))
    b = np.concatenate([t[np.cumsum(x[2])] for t, x in zip(to, blocks, strict=True)])
    m, n = (np.concatenate([x[i] for x in blocks]).astype(np.int64) for i in (4, 5))
    pair, pair_at = np.unique((m * v + b) * v + a, return_inverse=True)
    key, at = np.unique(pair_at * v + c, return_inverse=True)
    n = np.bincount(at, weights=n).astype(np.int64)
    pair, c = pair[key // v], key % v
    m, b, a = pair // (v * v), pair // v % v, pair % v
    yield pd.DataFrame({"kind": 0, "part": part, "model": 0, "w": 0, "c": 0, "n": 0, "data": [pack(names, *(x.astype(np.int32) for x in (a, _gaps(b), c)), m.astype(np.int8), n)]})
    two, n2 = np.unique((m * v + b) * v + c, return_counts=True)
    m2, b2, c2 = two // (v * v), two // v % v, two % v
    spread = np.isin(names, np.array(list(hot), dtype=np.int64))[b2]
    ends, n1 = np.unique((m2 * v + c2)[~spread], return_counts=True)
    found = [(1, ends // v, names[ends % v], 0, n1), (2, m2[spread], names[b2[spread]], names[c2[spread]], n2[spread])]
    for kind, x, y in ((3, m, n), (4, m2[~spread], n2[~spread])):
        few, k = np.unique(x[y <= 4] * 8 + y[y <= 4], return_counts=True)
        found.append((kind, few // 8, few % 8, 0, k))
    for kind, model, w, c, n in found:
        if len(n):
            yield pd.DataFrame({"kind": kind, "part": part, "model": model, "w": w, "c": c, "n": n, "data": None})


def _discounts(of: dict[int, int]) -> list[float]:
    n1, n2, n3, n4 = (of.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    return [min(max(k - (k + 1) * y * b / a if a else 0.5 * k, 0.05), k - 0.05) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


class Rest:
    """What holds in all parts: discounts by model and order, the sums of order 1, and of frequent words (order 2)."""

    def __init__(self) -> None:
        self.seen: dict = {}
        self.one: dict[int, tuple[float, float]] = {}
        self.two: dict[tuple[int, int], tuple[int, list[int]]] = {}

    def disc(self, model: int, order: int) -> np.ndarray:
        return np.array(_discounts(self.seen.get((model, order), {})))


def word_model(counts: DataFrame, parts: int, hot: Hot) -> tuple[DataFrame, Rest]:
    """``word_counts`` -> the model's parts (``part``, ``data``) and what holds in all of them."""
    def types(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(_types(pdf, hot), ignore_index=True)
    rows = staged(counts.groupBy("part").applyInPandas(types, TYPES), "kn-types")
    rest = Rest()

    def seen(order: int, model: int, k: int, n: int) -> None:
        of = rest.seen.setdefault((model, order), {})
        of[k] = of.get(k, 0) + n
    for r in rows.where("kind >= 3").groupBy("kind", "model", "w").agg(F.sum("n").alias("n")).collect():     # at most sixteen rows
        seen(3 if r.kind == 3 else 2, r.model, r.w, r.n)
    two = staged(rows.where("kind = 2").groupBy("model", "w", "c").agg(F.sum("n").alias("n")), "kn-two")
    classes = [F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2), F.count_if(F.col("n") >= 3)]
    for r in two.groupBy("model", "w").agg(F.sum("n").alias("total"), F.array(*classes).alias("k")).collect():      # the frequent words
        rest.two[r.model, r.w] = r.total, list(r.k)
    for r in two.where("n <= 4").groupBy("model", "n").agg(F.count(F.lit(1)).alias("k")).collect():
        seen(2, r.model, r.n, r.k)
    one = rows.where("kind = 1").select("model", "w", "n").unionByName(two.groupBy("model", F.col("c").alias("w")).agg(F.count(F.lit(1)).alias("n")))
    one = staged(one.groupBy("model", "w").agg(F.sum("n").alias("n")), "kn-one")
    for r in one.where("n <= 4").groupBy("model", "n").agg(F.count(F.lit(1)).alias("k")).collect():
        seen(1, r.model, r.n, r.k)
    for r in one.groupBy("model").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("types"), F.array(*classes).alias("k")).collect():     # at most two
        # an even share for each unit and for all unknown ones
        rest.one[r.model] = float(r.total), float(np.dot(rest.disc(r.model, 1), r.k)) / r.total / (r.types + 1)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            share = np.array([hot.get(w, 1) for w in pdf["w"].tolist()], dtype=np.int64)
            pdf = pdf.loc[pdf.index.repeat(share)]
            sub = np.arange(len(pdf)) - np.repeat(np.cumsum(share) - share, share)
            # a word's middle triples may lie in the same part twice
            yield pdf.assign(part=part_of(pdf["w"].to_numpy(dtype=np.int64), sub, parts)).drop_duplicates()[["part", "model", "w", "c", "n", "one"]]
    known = one.select("model", F.col("w").alias("c"), F.col("n").alias("one"))
    cols = "part int, model int, w long, c long, n long, one long"
    none = F.lit(0).cast("long")
    given = reduce(DataFrame.unionByName, [
        rows.where("kind = 1").select("part", "model", F.col("w").alias("c")).join(known.hint("merge"), ["model", "c"]).select("part", "model", none.alias("w"), "c", none.alias("n"), "one"),
        one.select("model", "w", F.col("w").alias("c"), none.alias("n"), F.col("n").alias("one")).mapInPandas(spread, cols).withColumn("w", none),
        two.join(known.hint("merge"), ["model", "c"]).select("model", "w", "c", "n", "one").mapInPandas(spread, cols)])
    given = staged(given, "kn-given")

    def joined(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        part = int((left if len(left) else right)["part"].iloc[0])
        names, a, b, c, m, n = unpack(left["data"].iloc[0]) if len(left) else (np.zeros(0, t) for t in (np.int64, *[np.int32] * 3, np.int8, np.int64))
        more = right["n"].to_numpy() > 0
        w, k, model, one = (right[x].to_numpy(dtype=np.int64) for x in ("w", "c", "model", "one"))
        every = np.unique(np.concatenate([names, w[more], k]))
        to = np.searchsorted(every, names).astype(np.int32)
        ends = np.zeros((2, len(every)), dtype=np.int32)
        ends[model, np.searchsorted(every, k)] = one
        two = [np.searchsorted(every, x[more]).astype(np.int32) for x in (w, k)]
        return pd.DataFrame({"part": [part], "data": [pack(every, *ends, to[a], to[np.cumsum(b)] if len(b) else b, to[c], m, n, *two, model[more].astype(np.int8), right["n"].to_numpy(dtype=np.int64)[more])]})
    model = staged(rows.where("kind = 0").select("part", "data").groupBy("part").cogroup(given.groupBy("part")).applyInPandas(joined, "part int, data binary"), "kn-model")
    for x in (rows, two, one, given):
        emptied(x)
    return model, rest


def emptied(df: DataFrame) -> None:
    """A staged frame that is read no more gives its disk back."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        df.sparkSession.createDataFrame([], df.schema).write.mode("overwrite").parquet(path)


class Part:
    """A part of one model, ready to be asked."""

    def __init__(self, data: list[np.ndarray], model: int, rest: Rest, hot: Hot) -> None:
        names, *ends, a, b, c, m, n, b2, c2, m2, n2 = data
        v = self.v = len(names) + 1                          # the last: words that the part does not have
        total, base = rest.one[model]
        d1, d2, d3 = (rest.disc(model, k) for k in (1, 2, 3))
        one = np.append(ends[model], 0)
        p1 = np.where(one > 0, (one - d1[np.clip(one, 1, 3) - 1]) / total, 0) + base
        self.gain1 = np.log(p1 / base)
        a, b, c, n = (x[m == model].astype(np.int64) for x in (a, b, c, n))
        often = np.append(np.isin(names, np.array(list(hot), dtype=np.int64)), False)
        key, k = np.unique((b * v + c)[~often[b]], return_counts=True)
        key = np.append(key, b2[m2 == model].astype(np.int64) * v + c2[m2 == model])
        k = np.append(k, n2[m2 == model])
        order = np.argsort(key)
        self.two, k = key[order], k[order]
        b_of, c_of = self.two // v, self.two % v
        d = d2[np.clip(k, 1, 3) - 1]
        sums, freed = np.bincount(b_of, weights=k, minlength=v), np.bincount(b_of, weights=d, minlength=v)
        for i in np.flatnonzero(often):
            if (model, int(names[i])) in rest.two:
                sums[i], classes = rest.two[model, int(names[i])]
                freed[i] = np.dot(d2, classes)
        back = np.divide(freed, sums, out=np.ones(v), where=sums > 0)
        self.back2 = np.log(back)
        below = back[b_of] * p1[c_of]
        p2 = (k - d) / sums[b_of] + below
        self.gain2 = np.log(p2 / below)
        self.pair, at = np.unique(b * v + a, return_inverse=True)
        d = d3[np.clip(n, 1, 3) - 1]
        sums, freed = np.bincount(at, weights=n), np.bincount(at, weights=d)
        self.back3 = np.log(freed / sums) if len(sums) else sums
        key = at * v + c
        order = np.argsort(key)
        self.three = key[order]
        below = (freed[at] / sums[at] * p2[np.searchsorted(self.two, b * v + c)]) if len(at) else np.zeros(0)
        p3 = (n - d) / sums[at] + below if len(at) else below
        self.gain3 = np.log(p3 / below)[order]

    def logs(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """What each triple adds: its middle word's gain unless it is a start (``first``), and unless its last is the end (``last``), its context's
        weights and the gains of its last two and of all."""
        v = self.v

        def found(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(table, key)
            at[at == len(table)] = 0
            return at, (table[at] == key if len(table) else np.zeros(len(key), dtype=bool)) & ~last
        out = np.where(first, 0.0, self.gain1[b]) + np.where(last, 0.0, self.back2[b])
        at, ok = found(self.two, b * v + c)
        out[ok] += self.gain2[at[ok]]
        pair, ok = found(self.pair, b * v + a)
        out[ok] += self.back3[pair[ok]]
        at, ok3 = found(self.three, pair * v + c)
        ok &= ok3
        out[ok] += self.gain3[at[ok]]
        return out


def word_logs(rows: DataFrame, model: DataFrame, rest: Rest, parts: int, hot: Hot) -> DataFrame:
    """``tk``, ``model``, ``t`` -> ``tk``, ``logs``, ``n`` (units) of each row that has units: the log probability without the empty context's weight."""
    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        for i, (names, (a, b, c, text), docs) in enumerate(_blocks(batches)):
            block, told = (task << 32) + i, pack(docs["tk"].to_numpy(dtype=np.int64), docs["units"].to_numpy(dtype=np.int64))
            who = text * np.int32(2) + docs["model"].to_numpy(dtype=np.int32)[text]
            for part, at in _dealt(names, a, b, parts, hot):
                own, x, y, z = _own(names, a[at], b[at], c[at])
                yield pd.DataFrame({"part": [part], "block": block, "data": [pack(own, x, _gaps(y), z, who[at])], "docs": [told]})
                told = None                                                            # with the block's first part only

    def answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        data = unpack(held["data"].iloc[0]) if len(held) else None
        of = {m: Part(data, m, rest, hot) for m in rest.one} if data and len(asked) else {}
        out = []
        for r in asked.itertuples():
            names, a, b, c, who = unpack(r.data)
            b = np.cumsum(b)
            first, last = names[b] == START, names[c] == END
            sums = np.zeros(len(b))
            if of:
                at = np.searchsorted(data[0], names)
                at[at == len(data[0])] = 0
                at = np.where(data[0][at] == names, at, len(data[0]))
                for m, table in of.items():
                    mine = np.flatnonzero(who % 2 == m)
                    sums[mine] = table.logs(*(at[x[mine]] for x in (a, b, c)), first[mine], last[mine])
            doc, at = np.unique(who // 2, return_inverse=True)
            out.append((r.block, pack(doc.astype(np.int32), np.bincount(at, weights=sums)), r.docs))
        return pd.DataFrame(out, columns=["block", "data", "docs"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        tk, n = unpack(next(x for x in pdf["docs"] if x is not None))
        logs = np.zeros(len(tk))
        for doc, x in map(unpack, pdf["data"]):
            logs[doc] += x
        return pd.DataFrame({"tk": tk, "logs": logs, "n": n})[n > 0]
    asked = rows.mapInPandas(ask, "part int, block long, data binary, docs binary")
    answered = asked.groupBy("part").cogroup(model.groupBy("part")).applyInPandas(answer, "block long, data binary, docs binary")
    return answered.groupBy("block").applyInPandas(added, "tk long, logs double, n long")


def key_filter(keys: DataFrame) -> np.ndarray:
    """Filter (64-bit words) of the column ``key``, of a fixed size: at most 2^(BLOOM_BITS - 6) rows reach the driver.  More keys
    let more others through, and none is lost."""
    mask = F.lit((1 << BLOOM_BITS) - 1)
    bits = F.explode(F.array(F.col("key").bitwiseAND(mask), F.shiftrightunsigned("key", 32).bitwiseAND(mask)))
    rows = (keys.select(bits.alias("p")).select(F.shiftright("p", 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(63).cast("int")).alias("bit"))
            .groupBy("at").agg(F.bit_or("bit").alias("bits")).collect())
    words = np.zeros(1 << (BLOOM_BITS - 6), dtype=np.int64)
    words[[r["at"] for r in rows]] = [r["bits"] for r in rows]
    return words.view(np.uint64)


def maybe(words: np.ndarray, key: np.ndarray) -> np.ndarray:
    out, k, mask = np.ones(len(key), dtype=bool), key.view(np.uint64), np.uint64((1 << BLOOM_BITS) - 1)
    for p in (k & mask, (k >> np.uint64(32)) & mask):
        out &= (words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1
    return out


def _likely(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """The rows that may be trusted, so that few others are dealt by id with their text."""
    held = rows.sparkSession.sparkContext.broadcast(key_filter(trusted.select(F.xxhash64("id").alias("key"))))

    @F.pandas_udf("boolean")
    def may(key: pd.Series) -> pd.Series:
        return pd.Series(maybe(held.value, key.to_numpy(dtype=np.int64)))
    return rows.where(may(F.xxhash64("id")))


def quality(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, id_col: str = "doc_id", text_col: str = "text",
            lang_col: str = "lang") -> DataFrame:
    """``id``, ``lang``, ``n_chars``, ``perplexity``, ``low``, ``high``, ``keep`` per row; see the module."""
    spark = docs.sparkSession
    bounded_batches(spark)
    spark.conf.set(CLEANUP_KEY, spark.conf.get(CLEANUP_KEY, "true"))
    trusted = (labels.select(labels[id_col].alias("id"), (F.coalesce(labels["quality"] == 1, F.lit(False)) & ~F.coalesce(labels["toxic"] == 1, F.lit(False))).alias("good"))
               .where("id is not null").groupBy("id").agg(F.bool_and("good").alias("good")).where("good").select("id"))
    text = text_or_empty(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), docs[lang_col].cast("string").alias("lang"), text.alias("t"))
    # one way at every size: sort-merge joins
    rows = rows.withColumn("tk", F.xxhash64("t"))
    other = F.lit(1) - F.pmod("tk", F.lit(2))
    chars = rows.agg(F.sum(F.char_length("t").cast("long"))).first()[0] or 0
    parts = max(partitions(spark), math.ceil(chars / PART_CHARS))
    hot = frequent(rows, parts)
    taught = _likely(rows, trusted).join(trusted.hint("merge"), "id", "left_semi").select((F.lit(1) - other).cast("long").alias("model"), "t")
    table, rest = word_model(word_counts(taught, parts, hot), parts, hot)
    if not rest.one:
        return rows.select("id", "lang", F.char_length("t").cast("long").alias("n_chars"), *(F.lit(None).cast("double").alias(c) for c in ("perplexity", "low", "high")),
                           (F.length(F.trim("t")) > 0).alias("keep"))
    model = other if len(rest.one) == 2 else F.lit(next(iter(rest.one)))
    asked = rows.select("tk", model.cast("long").alias("model"), "t")
    rounds = ROUNDS if chars > ONE_ROUND else 1
    # each round's requests go before the next; equal texts add up in both sums alike
    sums = reduce(DataFrame.unionByName, [
        staged(word_logs(asked.where(F.pmod(F.xxhash64("tk"), F.lit(rounds)) == i), table, rest, parts, hot).groupBy("tk").agg(F.sum("logs").alias("logs"), F.sum("n").alias("n")), f"kn-sums{i}")
        for i in range(rounds)])
    weight = {m: math.log(base) for m, (_, base) in rest.one.items()}
    base = F.when(other == 0, F.lit(weight[0])).otherwise(F.lit(weight[1])) if len(weight) == 2 else F.lit(next(iter(weight.values())))
    sums = sums.withColumn("logs", F.col("logs") + F.col("n") * base)
    scored = (rows.select("id", "lang", "tk", F.char_length("t").cast("long").alias("n_chars")).join(sums.hint("merge"), "tk", "left")
              .select("id", "lang", "n_chars", F.exp(-F.col("logs") / F.col("n")).alias("perplexity")))
    scored = staged(scored, "kn-scored")
    known = scored.join(trusted, "id", "left_semi").where("perplexity is not null")
    qs = F.percentile_approx("perplexity", [low, high], 10000)
    by_lang = known.groupBy(F.col("lang").alias("l")).agg(qs.alias("q"))
    overall = known.agg(qs.alias("q")).first().q or [None, None]
    near = [F.lit(x).cast("double") for x in overall]
    out = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left")
    lo, hi = (F.coalesce(F.col("q")[i], near[i]) for i in (0, 1))
    keep = F.coalesce((F.col("perplexity") >= lo) & (F.col("perplexity") <= hi), F.lit(False))
    return out.select("id", "lang", "n_chars", "perplexity", lo.alias("low"), hi.alias("high"), keep.alias("keep"))
