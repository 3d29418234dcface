"""Op 12: packing of documents into token windows, bounded-space online best fit.

1. Every task encodes its documents and packs them as they come, keeping ``OPEN`` windows open.  A
   document of a window or more fills whole windows of its own first; what is left goes into the open window with
   the least room that holds it (best fit).  When none fits and all are in use, the fullest is topped up with
   the head of the piece and emitted -- documents may be cut freely -- and its place is free again.
2. Windows still open at a task's end are the leftovers; only their pieces carry ids.  They are dealt to tasks
   of at most ``MERGE`` windows and packed in the same way, round by round, until one task holds them.
3. That task pours its last open windows into each other; the rest, less than a window, is cut into windows of
   powers of two, so that no padding is left.

A word's tokens do not depend on its neighbours (the tokenizer drops white space and never merges across it; ``word_rules``
reads that from its file, others are refused), so a worker encodes each distinct word once, in a bounded table, and builds documents by array operations.

Cases: a null or empty text is the closing id alone; ids may be null or repeated, each row is packed; special strings
inside texts are read as the library does by default; very long texts are encoded in slices and cut into windows;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgflow.llm.common import WORD, staged, text_or_empty

WINDOW = 2048
OPEN = 16                            # open windows of a task
MERGE = 1024                         # windows of leftovers a task takes
CLOSING = 1                          # id after each document
TOKENIZER = "word_bpe_49k.json"
SLICE = 1 << 20                      # characters encoded side by side
CACHE = 3 << 18                      # words remembered
WORDS = re.compile(WORD)
# fixed value: the pre-tokenizer's pattern under which a run of letters always ends a word
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# texts of these signs only (no marks, no white space on which libraries differ) are parted after letters, too
PLAIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u012fŒœ]*")
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-\u012fŒœ"
LETTER_RUNS = re.compile(rf"[^{LETTERS}\s]*[{LETTERS}]+|[^{LETTERS}\s]+")
SPACE = re.compile(r"[\x20\x09-\x0D]")
PIECES = "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, open boolean"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def word_rules(path: str) -> str | None:
    """``space``: white space parts words whatever stands around it, as it is matched away by the pre-tokenizer's first
    step and no normalizer looks across it.  ``letters``: a run of letters ends a word, too (the pattern ``RUNS`` and lower case).
    None: neither is known."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    pre, norm = t["pre_tokenizer"] or {}, t["normalizer"] or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    steps = [n["type"] for n in norm.get("normalizers", [norm] if norm else [])]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    drops = first.get("type") == "Split" and first.get("invert") and first.get("behavior") == "Removed" and r"[^\s" in pattern
    special = any(SPACE.search(a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"] for a in t["added_tokens"])
    if not drops or special or t["post_processor"] or not set(steps) <= {"NFC", "Replace", "Lowercase"}:
        return None
    return "letters" if pattern == RUNS and steps == ["NFC", "Replace", "Lowercase"] else "space"


class Numbers(dict):
    """Word -> number in order of appearance; ``new`` lists the words not yet encoded."""

    def __init__(self):
        super().__init__({"": 0})
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordIds:
    """Ids of texts, joined from the ids of their words; every word is encoded once (a bounded table)."""

    def __init__(self, path: str, closing: int = CLOSING):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [a.content for a in self.tok.get_added_tokens_decoder().values()]
        self.letters, self.closing = word_rules(path) == "letters", closing
        self._clear()

    def _clear(self) -> None:
        self.known = Numbers()                       # the empty word stands for the closing id
        self.first, self.count = np.zeros(1, dtype=np.int64), np.ones(1, dtype=np.int64)
        self.flat = np.array([self.closing], dtype=np.uint32)

    def words(self, text: str) -> list[str]:
        if self.letters and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return LETTER_RUNS.findall(text.lower())
        return WORDS.findall(text)

    def ids(self, words: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after the other, and where each list's ids stop."""
        known = self.known
        if len(known) > CACHE:
            self._clear()
            known = self.known
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        at = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(sizes.sum()))
        if known.new:
            got = [e.ids for e in self.tok.encode_batch_fast(known.new, add_special_tokens=False)]
            known.new = []
            n = np.fromiter(map(len, got), dtype=np.int64, count=len(got))
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(n) - n])
            self.count = np.concatenate([self.count, n])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(got), dtype=np.uint32, count=int(n.sum()))])
        n = self.count[at]
        stops = np.cumsum(n)
        where = np.repeat(self.first[at] - (stops - n), n)
        return self.flat[where + np.arange(len(where))], np.r_[0, stops][np.cumsum(sizes)]


@lru_cache(maxsize=1)
def coder_of(path: str, closing: int) -> WordIds:
    """One for each Python worker: its table of words serves all tasks that the worker runs."""
    return WordIds(path, closing)


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut at white space."""
    at = 0
    while len(text) - at > size:
        m = SPACE.search(text, at + size)
        if not m:
            break
        yield text[at:m.start()]
        at = m.start()
    yield text[at:] if at else text


def documents_ids(texts: list[str], coder: WordIds) -> Iterator[np.ndarray]:
    """Each text's ids with the closing one, in order; short texts are encoded together."""
    def flush() -> Iterator[np.ndarray]:
        if group:
            ids, stops = coder.ids(group)
            yield from np.split(ids, stops[:-1])

    group: list[list[str]] = []
    chars = 0
    for t in texts:
        if chars + len(t) > SLICE:
            yield from flush()
            group, chars = [], 0
        if len(t) > SLICE:
            parts = [coder.ids([coder.words(s)])[0] for s in slices(t)]
            yield np.concatenate([*parts, np.array([coder.closing], dtype=np.uint32)])
            continue
        group.append([*coder.words(t), ""])
        chars += len(t)
    yield from flush()


class OpenWindows:
    """A fixed number of open windows; ``add`` places a piece best-fit and returns emitted windows as lists
    of (document, start, ids)."""

    def __init__(self, size: int = WINDOW, limit: int = OPEN):
        self.size, self.limit, self.held, self.room, self.next = size, limit, {}, [], 0

    def _put(self, k: int, doc, start: int, ids: np.ndarray) -> list:
        """Into open window ``room[k]``; the window, if that fills it."""
        free, w = self.room.pop(k)
        self.held[w].append((doc, start, ids))
        if free == len(ids):
            return [self.held.pop(w)]
        insort(self.room, (free - len(ids), w))
        return []

    def add(self, doc, start: int, ids: np.ndarray) -> list:
        out = []
        while len(ids) >= self.size:
            out.append([(doc, start, ids[:self.size])])
            start, ids = start + self.size, ids[self.size:]
        while len(ids):
            k = bisect_left(self.room, (len(ids), -1))
            if k < len(self.room):                       # the tightest window that holds it
                return out + self._put(k, doc, start, ids)
            if len(self.room) < self.limit:
                insort(self.room, (self.size, self.next))
                self.held[self.next] = []
                self.next += 1
                continue
            free = self.room[0][0]                       # the fullest: topped up and emitted
            out += self._put(0, doc, start, ids[:free])
            start, ids = start + free, ids[free:]
        return out

    def rest(self) -> list:
        """The windows still open, fullest first."""
        return [self.held[w] for _, w in self.room]


def pour(windows: list, size: int) -> Iterator[list]:
    """All pieces in full windows; the rest in windows of falling powers of two."""
    pieces = [p for w in windows for p in w]
    left = sum(len(ids) for _, _, ids in pieces)
    now, room = [], 0
    for doc, start, ids in pieces:
        while len(ids):
            if not room:
                if now:
                    yield now
                now, room = [], size if left >= size else 1 << (left.bit_length() - 1)
                left -= room
            n = min(room, len(ids))
            now.append((doc, start, ids[:n]))
            start, ids, room = start + n, ids[n:], room - n
    if now:
        yield now


def _rows(windows: list, base: int | None, keep_ids: bool) -> list[tuple]:
    """Rows of windows numbered from ``base``."""
    out = []
    for k, w in enumerate(windows):
        at = 0
        for (doc, total), start, ids in w:
            raw = ids.astype("<u4").tobytes()
            out.append((doc, start, len(ids), zlib.crc32(raw), total, base + k, at, raw if keep_ids else None))
            at += len(ids)
    return out


def _number(step: int) -> int:
    """First sequence number of this task: step, partition, count."""
    return step << 56 | TaskContext.get().partitionId() << 32


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, open_windows: int = OPEN, closing: int = CLOSING, with_ids: bool = False,
         id_col: str = "doc_id", text_col: str = "text", merge: int = MERGE) -> DataFrame:
    """``id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` per piece, and ``ids`` (little-endian
    unsigned 32-bit) if asked for; see the module."""
    path = path or tokenizer_path()
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    if word_rules(path) is None:
        raise ValueError("packing needs a tokenizer whose words end at white space")
    if open_windows * 4 > merge:
        raise ValueError("a merging task must take many more windows than it leaves open")
    rows = docs.select(docs[id_col].cast("string").alias("id"), text_or_empty(docs, text_col).alias("t"))

    def emit(done: list, left: list, step: int, count: int) -> pd.DataFrame:
        base = _number(step)
        out = [(*r, False) for r in _rows(done, base + count, with_ids)]
        out += [(*r, True) for r in _rows(left, base + count + len(done), True)]
        return pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder, windows, count = None, OpenWindows(window, open_windows), 0
        for pdf in batches:
            coder = coder or coder_of(path, closing)
            done = []
            for doc, ids in zip(pdf["id"].tolist(), documents_ids(pdf["t"].tolist(), coder), strict=True):
                done += windows.add((doc, len(ids)), 0, ids)
                if len(done) >= 4096:
                    yield emit(done, [], 0, count)
                    done, count = [], count + len(done)
            yield emit(done, [], 0, count)
            count += len(done)
        yield emit([], windows.rest(), 0, count)

    def again(step: int, last: bool):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            windows, count = OpenWindows(window, open_windows), 0
            for pdf in batches:
                done = []
                for r in pdf.itertuples(index=False):
                    done += windows.add((r.id, r.doc_tokens), r.start, np.frombuffer(r.ids, dtype="<u4"))
                yield emit(done, [], step, count)
                count += len(done)
            rest = windows.rest()
            yield emit(list(pour(rest, window)), [], step, count) if last else emit([], rest, step, count)
        return run

    packed, step, parts = staged(rows.mapInPandas(first, PIECES), "packed"), 0, []
    while True:
        parts.append(packed.where("not open"))
        left = packed.where("open")
        n = left.agg(F.count_distinct("sequence_id")).first()[0]
        if not n:
            break
        step += 1
        last = n <= merge
        # a window's pieces stay together and in order, so that reruns pack alike
        dealt = left.repartition(1 if last else -(-n // (merge // 2)), "sequence_id").sortWithinPartitions("sequence_id", "offset")
        packed = staged(dealt.mapInPandas(again(step, last), PIECES), f"packed{step}")
    out = reduce(DataFrame.unionByName, parts).withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))
    return out.drop("open") if with_ids else out.drop("open", "ids")
