"""Op 13: periodic runs of words by online dyadic square catching.

A run is a longest stretch of consecutive words that repeats with smallest period q (words q apart are equal), of
at least ``min_exponent`` periods and ``min_length`` words.

Every completed block of 2^k words (at a multiple of 2^k) becomes a catcher of level k: it waits for its own words to come again
2 * 2^k to 4 * 2^k - 1 words on (level 3, the lowest, from 1 on).  Two (level 3: four) catchers of a level are alive at a time.
The left part of a run, up to its last period, has 2q and 16 words or more, so it holds a whole block of its level, whose catcher must fire.

1. Each appended word completes one suffix of 2^k words for each level, named by a hash made of the names of its two
   halves; it is compared with the live catchers of the level.  Catchers of a level do not look at each other, so a task advances
   all of them over all appended words of a stream at once, with array operations, level by level.
2. A catcher that fires on a diagonal (distance d) where the block before it has not fired has found a new square or its beginning.  Words
   are compared backwards and forwards from there (doubling steps), which also tells a false hash match.
3. Squares merge into runs: a firing inside a run found at a smaller period that divides d is that run again.  Stretches found
   twice keep the smallest period.

Documents of similar length are appended to one stream with a word of its own between them, which no square can span; a level works
only on streams long enough for it.  Work is words x levels, memory one batch's words.

Cases: a null or white text has no words and no runs; ids may be null or repeated, each row is judged by itself; very long texts
are one stream; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgflow.llm.common import WORD, text_or_empty

MIN_LENGTH, MIN_EXPONENT = 24, 3
BASE = 3                             # lowest level: blocks of 8 words
STREAM = 1 << 20                     # words of one stream (a longer document is a stream alone)
GROUP = 1 << 22                      # characters split side by side
WORDS = re.compile(WORD)


def _mix(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Name of a block of 2^(k+1) words from the names of its halves."""
    h = a * np.uint64(0x9E3779B185EBCA87 + 2 * k) + b * np.uint64(0xC2B2AE3D27D4EB4F + 4 * k)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x165667B19E3779F9)
    return h ^ (h >> np.uint64(29))


def _same(t: np.ndarray, i: int, d: int, step: int) -> int:
    """How many words from ``i`` on (``step`` 1) or back from it (-1) equal those ``d`` words further on."""
    n, size, done = len(t), 32, 0
    while True:
        if step > 0:
            a, b = i + done, min(i + done + size, n - d)
            if b <= a:
                return done
            off = np.flatnonzero(t[a:b] != t[a + d:b + d])
            if len(off):
                return done + int(off[0])
            done += b - a
        else:
            b = i - done + 1
            a = max(b - size, 0)
            if b <= a:
                return done
            off = np.flatnonzero(t[a:b] != t[a + d:b + d])
            if len(off):
                return done + (b - a) - 1 - int(off[-1])
            done += b - a
        size *= 2


class Catchers:
    """Runs of one stream of words (integers), level by level."""

    def __init__(self, words: np.ndarray, longest: int, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT):
        self.t, self.min_length, self.min_exponent = words, min_length, min_exponent
        self.longest = longest                       # words of the longest document in the stream
        self.found: dict[tuple[int, int], int] = {}  # (start, stop) -> smallest period

    def _fired(self, name: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(block start, distance) of the catchers of level ``k`` that fire first on their diagonal.  ``name[j]`` names the words j to j + 2^k - 1."""
        b, n = 1 << k, len(name)
        block = np.repeat(name[::b], b)[:n]          # at j: the block that began at or before j
        for back in range(4) if k == BASE else (2, 3):
            # catcher at (j // b - back) * b, for the suffix beginning at j
            j0 = back * b
            if j0 >= n:
                continue
            hit = name[j0:] == block[:n - j0]
            if back == 0:
                hit[::b] = False                     # a block is not its own repetition
            # on the same diagonal the block before covers it, so it need not be followed again
            first = hit.copy()
            first[b:] &= ~hit[:-b]
            j = np.flatnonzero(first) + j0
            s = (j // b - back) * b
            yield s, j - s

    def _cover(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts of the runs found so far, the furthest stop up to each, and that run's period."""
        runs = sorted((a, z, q) for (a, z), q in self.found.items())
        a, z, q = (np.array(c, dtype=np.int64) for c in zip(*runs, strict=True))
        top = np.maximum.accumulate(z)
        owner = np.maximum.accumulate(np.where(z == top, np.arange(len(z)), 0))
        return a, top, q[owner]

    def _follow(self, s: int, d: int, b: int) -> None:
        left = _same(self.t, s + b - 1, d, -1)
        if left < b:                                 # the names were equal, the words are not
            return
        start = s + b - left
        stop = s + b + _same(self.t, s + b, d, 1) + d
        if stop - start >= max(self.min_length, self.min_exponent * d):
            self.found[start, stop] = min(d, self.found.get((start, stop), d))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run, by start, then period."""
        name = self.t.astype(np.uint64)
        k = 0
        while len(name) and (k <= BASE or (self.min_exponent << (k + 1)) <= self.longest):
            if k >= BASE:
                s, d = (np.concatenate(c) for c in zip((np.zeros(0, np.int64),) * 2, *self._fired(name, k), strict=True))
                order = np.lexsort((s, d))
                known, size = None, 0
                for i in order:
                    at, q = int(s[i]), int(d[i])
                    if self.min_exponent * q > self.longest:
                        break
                    if self.found and (known is None or len(self.found) >= size + 16):
                        known, size = self._cover(), len(self.found)
                    if known is not None:
                        r = int(np.searchsorted(known[0], at, "right")) - 1
                        if r >= 0 and known[1][r] >= at + q + (1 << k) and q % int(known[2][r]) == 0:
                            continue                 # inside a run of a smaller period
                    self._follow(at, q, 1 << k)
            half = 1 << k
            name = _mix(name[:-half], name[half:], k) if len(name) > half else name[:0]
            k += 1
        return sorted((a, z - a, q) for (a, z), q in self.found.items())


def find_runs(docs: list[np.ndarray], min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[list[tuple[int, int, int]]]:
    """Runs of each document (arrays of word numbers from 0 on)."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    order = sorted((i for i, d in enumerate(docs) if len(d) >= min_length), key=lambda i: len(docs[i]))
    at = 0
    while at < len(order):
        shortest, stop, size = len(docs[order[at]]), at, 0
        while stop < len(order) and len(docs[order[stop]]) < 2 * shortest and (stop == at or size + len(docs[order[stop]]) < STREAM):
            size += len(docs[order[stop]]) + 1
            stop += 1
        part = order[at:stop]
        sizes = np.array([len(docs[i]) + 1 for i in part], dtype=np.int64)
        begins = np.cumsum(sizes) - sizes
        # between two documents stands a word of its own (below all others)
        stream = np.concatenate([x for k, i in enumerate(part) for x in (docs[i], np.array([-1 - k], dtype=np.int64))])
        for a, n, q in Catchers(stream, int(sizes[-1]) - 1, min_length, min_exponent).runs():
            k = int(np.searchsorted(begins, a, "right")) - 1
            out[part[k]].append((a - int(begins[k]), n, q))
        at = stop
    return out


def kept_words(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay when every run is cut down to its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for a, length, q in runs:
        edge[a + q] += 1
        edge[a + length] -= 1
    return np.cumsum(edge)[:n] == 0


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, id_col: str = "doc_id", text_col: str = "text",
                  positions: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """``id``, ``n_words``, ``runs`` (start, length, period; by start, then period), ``collapsed`` (the words that stay, joined by
    one space) per row.  ``positions(id, n)`` (the id as a string) may give the numbers of the words to read in place of 0 to n - 1; see the module."""
    if min_exponent < 3 or min_length < 3 << BASE:
        raise ValueError(f"catchers need at least three periods and {3 << BASE} words")
    rows = docs.select(docs[id_col].cast("string").alias("id"), text_or_empty(docs, text_col).alias("t"))
    schema = "id string, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

    def some(part: pd.DataFrame) -> pd.DataFrame:
        number: dict[str, int] = {}
        texts, arrays = [], []
        for doc, text in zip(part["id"].tolist(), part["t"].tolist(), strict=True):
            words = WORDS.findall(text)
            a = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
            at = positions(doc, len(words)) if positions else None
            if at is not None:
                a = a[at]
            texts.append((words, at))
            arrays.append(a)
        found, collapsed = find_runs(arrays, min_length, min_exponent), []
        for (words, at), runs in zip(texts, found, strict=True):
            if at is not None:
                words = [words[i] for i in at.tolist()]
            collapsed.append(" ".join(words if not runs else [words[i] for i in np.flatnonzero(kept_words(len(words), runs)).tolist()]))
        return pd.DataFrame({"id": part["id"], "n_words": [len(a) for a in arrays], "collapsed": collapsed,
                             "runs": [[{"start": a, "length": n, "period": q} for a, n, q in r] for r in found]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                which = (pdf["t"].str.len().cumsum() // GROUP).to_numpy()
                for _, part in pdf.groupby(which, sort=False):
                    yield some(part)
    return rows.mapInPandas(run, schema).withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))
