"""Op 2: token counts with overlap resynchronisation.

Texts of up to ``chunk_chars`` characters are counted in one piece.  A longer text is
cut -- in the plan, so that the chunks of one document spread over the cluster -- into
chunks that overlap; every chunk is encoded with offsets, and neighbours are spliced at
a token boundary that both encodings have and that is proven stable.  Where the overlap
holds none, it is widened fourfold for that text and the text is encoded again; at the latest
the overlap covers the text and it is encoded whole.

Why a boundary is stable: the byte-level pre-tokenizer splits text into runs of
letters, of digits, of other symbols (each with at most one leading space) and of white
space; merges never cross those splits.  At a place whose left character is a letter
or digit and whose right one is of another class, or whose left one is not white space
and whose right one is a space or newline, a run ends whatever came before, and what
follows is split by looking ahead only.  So tokens left and right of it do not depend
on each other.  A place inside a special string could look so to one chunk that begins
within it; the neighbour sees the whole string and lacks the boundary, so it isn't common.

The same proof lets short texts be counted as the sum over their ``space + word`` pieces -- a run of letters ends
one as well --, each encoded by the library once per task and remembered in a bounded table.  Tokenizers that do not split so are refused (``splits_bytewise``).

Cases: null is the empty text (0 tokens); ids may be null or repeated, counts belong to
texts; an empty table gives no rows; special strings inside texts are treated as the
library does by default; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgflow.llm.common import key128, partitions, staged, text_or_empty

CHUNK_CHARS = 65_536
OVERLAP = 512
CACHE = 1 << 19                      # pieces remembered
PIECE = re.compile(r"\s*\S+|\s+")
ODD_SPACE = re.compile(r"[^\S \t\n\r\x0b\x0c]")      # white space on which libraries may differ
SPLIT = re.compile(r"(?<=\S)(?=[ \n])")
# texts of these signs only (no marks, no other letters or white space) are parted after letters, too
PLAIN = re.compile(r"[\x00-\x1b\x20-\x84\x86-\x9f\xa1-\u012fŒœ]*")
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-\u012fŒœ"
LETTER_PIECE = re.compile(rf"\s*[^\s{LETTERS}]*[{LETTERS}]+|\s*[^\s{LETTERS}]+|\s+")
GROUP = 1 << 20                      # characters counted side by side
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def splits_bytewise(path: str) -> bool:
    """Whether the file is a byte-level tokenizer with the usual split, without normalizer and prefix space, and with added tokens that
    hold no white space and swallow none: what the proof above rests on."""
    with open(path, encoding="utf-8") as f:
        t = json.load(f)
    pre = t.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not t.get("normalizer")
    return bool(plain) and not any(re.search(r"\s", a["content"]) or a["lstrip"] or a["rstrip"] or a["single_word"] for a in t.get("added_tokens", []))


def _load(path: str):
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class Numbers(dict):
    """Piece -> its number; ``new`` lists the pieces not yet counted."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.new.append(piece)
        return n


class PieceCounter:
    """Tokens of texts as sums over pieces between stable boundaries; a piece is encoded once (a bounded table)."""

    def __init__(self, tok):
        self.tok, self.special = tok, [a.content for a in tok.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self):
        self.known, self.size = Numbers(), np.zeros(0, dtype=np.int64)

    def pieces(self, text: str) -> list[str]:
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return LETTER_PIECE.findall(text)
        return SPLIT.split(text) if ODD_SPACE.search(text) else PIECE.findall(text)

    def counts(self, texts: list[str]) -> list[int]:
        out: list[int] = []
        for group in self._groups(texts):
            if len(self.known) > CACHE:
                self._clear()
            rows = [self.pieces(t) for t in group]
            sizes = np.fromiter(map(len, rows), dtype=np.int64, count=len(rows))
            at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(rows)), dtype=np.int64, count=int(sizes.sum()))
            new, self.known.new = self.known.new, []
            got = np.fromiter(map(len, self.tok.encode_batch_fast(new, add_special_tokens=False)) if new else (), dtype=np.int64, count=len(new))
            self.size = np.concatenate([self.size, got])
            upto = np.r_[0, np.cumsum(self.size[at])]
            stops = np.cumsum(sizes)
            out += (upto[stops] - upto[stops - sizes]).tolist()
        return out

    @staticmethod
    def _groups(texts: list[str]) -> Iterator[list[str]]:
        group, chars = [], 0
        for t in texts:
            group.append(t)
            chars += len(t)
            if chars >= GROUP:
                yield group
                group, chars = [], 0
        if group:
            yield group


def _stable(text: str, p: int) -> bool:
    left, right = text[p - 1], text[p]
    if not left.isspace() and right in " \n":
        return True
    # only plain letters and digits, for which every Unicode table agrees
    if left.isascii() and left.isalpha():
        return right.isascii() and not right.isalpha()
    if left.isascii() and left.isdigit():
        return right.isascii() and not right.isdigit()
    return False


def stable_cuts(text: str, starts: np.ndarray, ends: np.ndarray, lo: int, hi: int) -> tuple[list[int], list[int]]:
    """Stable token boundaries at characters lo < p < hi of the text and the number of
    tokens before each.  ``starts``/``ends`` are the tokens' character offsets."""
    at = np.flatnonzero((starts[1:] > lo) & (starts[1:] < hi) & (ends[:-1] <= starts[1:])) + 1
    at = [int(k) for k in at if starts[k] > starts[k - 1] and _stable(text, int(starts[k]))]
    return [int(starts[k]) for k in at], at


CHUNK_SCHEMA = ("k1 long, k2 long, i int, n int, tokens long, left_pos array<long>, left_tok array<long>, "
                "right_pos array<long>, right_tok array<long>")


def _encode_chunks(path: str, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok = None
        for pdf in batches:
            tok = tok or _load(path)
            rows = []
            for r in pdf.itertuples(index=False):
                e = tok.encode(r.piece, add_special_tokens=False)
                off = np.array(e.offsets, dtype=np.int64).reshape(-1, 2)
                base, size = r.start, len(r.piece)
                left = stable_cuts(r.piece, off[:, 0], off[:, 1], 0, min(2 * overlap, size)) if r.i else ([], [])
                right = stable_cuts(r.piece, off[:, 0], off[:, 1], size - 2 * overlap, size) if r.i < r.n - 1 else ([], [])
                rows.append((r.k1, r.k2, r.i, r.n, len(off), [base + p for p in left[0]], left[1], [base + p for p in right[0]], right[1]))
            yield pd.DataFrame(rows, columns=["k1", "k2", "i", "n", "tokens", "left_pos", "left_tok", "right_pos", "right_tok"])
    return run


def long_counts(texts: DataFrame, path: str, chunk_chars: int, overlap: int) -> DataFrame:
    """``k1``, ``k2``, ``t`` (distinct long texts) -> ``k1``, ``k2``, ``n_tokens``, each round
    staged.  ``overlap`` characters stand on both sides of a cut."""
    spark, pending, done = texts.sparkSession, texts, None
    while True:
        o, size = overlap, max(chunk_chars, 4 * overlap)     # cuts stay in order; at last one chunk holds the text
        length = F.char_length("t")
        n = F.greatest(F.lit(1), F.ceil((length - 2 * o) / F.lit(size))).cast("int")
        chunks = (pending.select("k1", "k2", "t", n.alias("n"))
                  .select("k1", "k2", "t", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
                  .select("k1", "k2", "i", "n", F.greatest(F.lit(0), F.col("i") * size - F.lit(o)).cast("long").alias("start"),
                          F.when(F.col("i") == F.col("n") - 1, length).otherwise((F.col("i") + 1) * size + o).alias("stop"), "t")
                  .select("k1", "k2", "i", "n", "start", F.substring("t", (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")).alias("piece")))
        enc = (chunks.repartition(partitions(spark), "k1", "k2", "i")
               .mapInPandas(_encode_chunks(path, o), CHUNK_SCHEMA))
        enc = staged(enc, "token-chunks")
        left = enc.select("k1", "k2", (F.col("i") - 1).alias("i"), "left_pos", "left_tok")
        seam = (enc.where("i < n - 1").select("k1", "k2", "i", "right_pos", "right_tok").join(left, ["k1", "k2", "i"])
                .withColumn("cut", F.array_min(F.array_intersect("right_pos", "left_pos")))
                # what both encodings have beyond the cut on one side only
                .select("k1", "k2", F.when(F.col("cut").isNotNull(), F.element_at("right_tok", F.array_position("right_pos", F.col("cut")).cast("int"))
                                           - F.element_at("left_tok", F.array_position("left_pos", F.col("cut")).cast("int"))).alias("shift"), F.col("i")))
        seams = seam.groupBy("k1", "k2").agg(F.sum("shift").alias("shift"), F.count("shift").alias("cuts"))
        totals = enc.groupBy("k1", "k2").agg(F.sum("tokens").alias("tokens"), F.first("n").alias("n"),
                                             F.sum(F.when(F.col("i") < F.col("n") - 1, F.col("tokens")).otherwise(F.lit(0))).alias("inner_tokens"))
        per = staged(totals.join(seams, ["k1", "k2"], "left")
                     .select("k1", "k2", F.when((F.col("n") == 1) | (F.col("cuts") == F.col("n") - 1),
                                                F.col("tokens") - F.col("inner_tokens") + F.coalesce("shift", F.lit(0))).alias("n_tokens")), "token-rounds")
        ok = per.where("n_tokens is not null")
        done = ok if done is None else done.unionByName(ok)
        failed = per.where("n_tokens is null").select("k1", "k2")
        if failed.isEmpty():
            return done
        pending, overlap = pending.join(failed, ["k1", "k2"], "left_semi"), overlap * 4


def token_counts(docs: DataFrame, path: str | None = None, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``n_bytes``, ``n_tokens`` per row; see the module."""
    path = path or tokenizer_path()
    if not splits_bytewise(path):
        raise ValueError("the stable boundaries are proven for byte-level tokenizers only")
    text = text_or_empty(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), text.alias("t"))
    out = rows.select("id").schema.simpleString()[7:-1] + ",n_bytes long,n_tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = None
        for pdf in batches:
            counter = counter or PieceCounter(_load(path))
            yield pd.DataFrame({"id": pdf["id"], "n_bytes": pdf["n_bytes"], "n_tokens": np.array(counter.counts(pdf["t"].tolist()), dtype=np.int64)})

    size = F.octet_length("t").cast("long").alias("n_bytes")
    short = rows.where(F.char_length("t") <= chunk_chars).select("id", size, "t").mapInPandas(run, out)
    long = rows.where(F.char_length("t") > chunk_chars).select("id", size, *key128(F.col("t")), "t")
    texts = long.groupBy("k1", "k2").agg(F.first("t").alias("t"))
    counts = long_counts(staged(texts, "long-texts"), path, chunk_chars, overlap)
    return short.unionByName(long.drop("t").join(counts, ["k1", "k2"]).select("id", "n_bytes", "n_tokens"))
