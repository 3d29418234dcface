"""Op 6: removal of lines that many documents share.

A line's key is the line stripped of ASCII white space and lower-cased (A-Z).  Keys of
at least ``min_chars`` code points found in at least ``min_docs`` documents lose
all their lines except in the largest doc_id that holds them.

1. The plan splits texts into lines and keeps (128-bit key hash, doc_id, text key,
   position): no text.
2. Rows are range-partitioned by (hash, falling doc_id, text key, position) and sorted within
   the partitions.  Range bounds fall inside a hot key too, so a line in a third of all rows spreads
   over many tasks.
3. Every task streams its sorted rows, holding one batch and the rows of a key's first
   ``min_docs`` - 1 documents.  The first document of a key keeps its lines, the others lose
   them.  Only the first and the last key of a partition can reach into its neighbours; what they
   leave undecided is passed on.
4. Undecided keys -- at most two a partition -- are settled from their documents, counted
   in two map-side combined steps.
5. Dropped positions become one compressed keep bitmap per document, which is
   what the operator returns; ``apply_bitmap`` gives the text.

Cases: ids are integers (the largest keeps its lines; text that is no number fails the job); a null or empty text is one empty line; a null doc_id counts as one document,
below all others; rows with equal doc_id are one document for the count, and each
keeps its own bitmap (documents are told apart by id and text); equal rows get equal
bitmaps; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from kgflow.llm.common import WS, ascii_lower, key128, partitions, staged, text_or_empty

MIN_CHARS, MIN_DOCS = 20, 3
NO_ID = -(1 << 63)
DROPS = "h1 long, h2 long, id long, k1 long, k2 long, pos int, open boolean"


def line_rows(rows: DataFrame, min_chars: int) -> DataFrame:
    """``id``, ``k1``, ``k2``, ``t`` -> one row per long enough line."""
    lines = rows.select(F.coalesce("id", F.lit(NO_ID)).alias("id"), "k1", "k2", F.posexplode(F.split("t", "\n")).alias("pos", "line"))
    key = ascii_lower(F.trim(F.col("line"), F.lit(WS)))
    lines = lines.select("id", "k1", "k2", "pos", key.alias("key")).where(F.char_length("key") >= min_chars)
    return lines.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(0x5EED), "key").alias("h2"), "id", "k1", "k2", "pos")


def _stream(min_docs: int):
    """Rows sorted by key and falling doc_id -> dropped rows, and undecided ones.

    The first document seen of a key is the one that keeps its lines, so from the
    ``min_docs``-th document on rows are passed on at once; only the rows of the documents
    before it are held.  The partition's first key may have begun in the partition before: its
    rows stay open.  The last key may go on in the next one: it leaves its held
    rows open, or, if decided, a marker (pos -1) for each of ``min_docs`` documents."""
    cols = ["h1", "h2", "id", "k1", "k2", "pos"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first_key = key = None
        ids_seen: list[int] = []
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            h1, h2, out = pdf["h1"].to_numpy(), pdf["h2"].to_numpy(), []
            cut = np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1
            starts, stops = np.r_[0, cut], np.r_[cut, len(h1)]
            edges = [(starts[0], stops[0])] + ([(starts[-1], stops[-1])] if len(starts) > 1 else [])
            for e, (a, b) in enumerate(edges):
                if e and len(starts) > 2:        # keys that begin and end inside this batch, at once
                    inner, sizes = pdf.iloc[starts[1]:stops[-2]], (stops - starts)[1:-1]
                    g, ids = np.repeat(np.arange(len(sizes)), sizes), inner["id"].to_numpy()
                    new = np.r_[True, (g[1:] != g[:-1]) | (ids[1:] != ids[:-1])]
                    top = ids[np.cumsum(sizes) - sizes]
                    drop = (np.bincount(g[new], minlength=len(sizes))[g] >= min_docs) & (ids != top[g])
                    out.append(inner.loc[drop, cols].assign(open=False))
                part = pdf.iloc[a:b]
                if (now := (int(h1[a]), int(h2[a]))) != key:
                    key, ids_seen, held = now, [], []
                    first_key = first_key or key
                if key == first_key:
                    out.append(part[cols].assign(open=True))
                    continue
                for x in pd.unique(part["id"])[:min_docs + 1]:
                    if len(ids_seen) < min_docs and (not ids_seen or int(x) != ids_seen[-1]):
                        ids_seen.append(int(x))
                held.append(part)
                if len(ids_seen) == min_docs:
                    f = pd.concat(held)
                    out.append(f.loc[f["id"] != ids_seen[0], cols].assign(open=False))
                    held = []
            if out:
                yield pd.concat(out)
        if key is not None and key != first_key:
            if len(ids_seen) == min_docs:
                yield pd.DataFrame([(*key, x, 0, 0, -1, True) for x in ids_seen], columns=[*cols, "open"])
            elif held:
                yield pd.concat(held)[cols].assign(open=True)
    return run


def dropped_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``id``, ``k1``, ``k2``, ``pos`` of the lines that go (steps 2 to 4)."""
    n = partitions(lines.sparkSession)
    order = [F.col("h1"), F.col("h2"), F.desc("id"), F.col("k1"), F.col("k2"), F.col("pos")]
    decided = staged(lines.repartitionByRange(n, *order).sortWithinPartitions(*order)
                     .mapInPandas(_stream(min_docs), DROPS), "line-drops")
    undecided = decided.where("open")
    # at most two keys a partition: their documents, counted
    top = (undecided.groupBy("h1", "h2", "id").agg(F.count(F.lit(1)).alias("c"))
           .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("top")).where(F.col("docs") >= min_docs))
    settled = undecided.join(F.broadcast(top), ["h1", "h2"]).where("id <> top and pos >= 0")
    cols = ["id", "k1", "k2", "pos"]
    return decided.where("not open").select(*cols).unionByName(settled.select(*cols))


def _bitmap(n: int, gone: np.ndarray) -> bytes:
    keep = np.ones(n + -n % 8, dtype=np.uint8)            # whole bytes
    keep[gone] = 0
    return zlib.compress(np.packbits(keep).tobytes(), 1)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``k1``, ``k2``, ``n_dropped``, ``bitmap`` (zlib of the packed keep bits up to the
    last dropped line; later lines stay) of every distinct document that loses lines."""
    text = text_or_empty(docs, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("id"), *key128(text), text.alias("t"))
    gone = dropped_lines(line_rows(rows, min_chars), min_docs)

    @F.pandas_udf("binary")
    def pack(pos: pd.Series) -> pd.Series:
        return pd.Series([_bitmap(int(max(p)) + 1, np.asarray(p, dtype=np.int64)) for p in pos])

    per = gone.groupBy("id", "k1", "k2").agg(F.collect_set("pos").alias("pos"))
    return per.select("id", "k1", "k2", F.size("pos").cast("long").alias("n_dropped"), pack("pos").alias("bitmap"))


@F.pandas_udf(StringType())
def apply_bitmap(text: pd.Series, bitmap: pd.Series) -> pd.Series:
    """The lines whose bit is set, and those after the bitmap's end."""
    out = []
    for t, b in zip(text, bitmap, strict=True):
        bits = np.unpackbits(np.frombuffer(zlib.decompress(b), dtype=np.uint8))
        lines = t.split("\n")
        out.append("\n".join(x for i, x in enumerate(lines) if i >= len(bits) or bits[i]))
    return pd.Series(out, dtype=object)
