"""M operators: scoring predictions against references.

Row-level parts are Column expressions; corpus statistics are one aggregate.
Texts are tokenised by Column expressions only; BLEU and ROUGE then count n-grams per row
in Arrow batches with array operations over all rows of a batch (no loop over rows, no
shuffle).  Counting by sorting and folding arrays inside the row was measured too and
took three times as long.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgflow.functions.forms import relations, relations_list, skeleton, skeleton_list
from kgflow.session import ensure_checkpoint_dir


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ratio(hit: Column) -> Column:
    """Share of rows; null on an empty set instead of a division by zero."""
    return F.try_divide(F.sum(hit.cast("double")), F.count(F.lit(1)).cast("double"))


def exact_hit(pred, golds) -> Column:
    """M1 row part: the prediction is one of the alternatives (missing -> miss)."""
    return F.coalesce(F.array_contains(_c(golds), _c(pred)), F.lit(False))


def skeleton_hit(pred, golds) -> Column:
    """M2 row part: skeleton of the prediction among skeletons of the golds."""
    return F.coalesce(F.array_contains(skeleton_list(golds), skeleton(_c(pred))), F.lit(False))


def relation_hit(pred, golds) -> Column:
    """M3 row part: ordered relation list equal to that of some alternative."""
    p = relations(_c(pred))
    return F.coalesce(F.exists(relations_list(golds), lambda r: r == p), F.lit(False))


def attach_gold(gold: DataFrame, predictions: DataFrame, key: str = "idx") -> DataFrame:
    """Align predictions with the gold by an explicit key (the reference zips
    two lists by position and silently truncates).  The gold side drives a
    left join, so a missing prediction stays in the denominator as a miss."""
    return gold.join(predictions, key, "left")


def exact_match(df: DataFrame, pred="pred", golds="golds") -> DataFrame:
    return df.agg(_ratio(exact_hit(pred, golds)).alias("accuracy"))


def skeleton_match(df: DataFrame, pred="pred", golds="golds") -> DataFrame:
    return df.agg(_ratio(skeleton_hit(pred, golds)).alias("skeleton_match"))


def relation_match(df: DataFrame, pred="pred", golds="golds") -> DataFrame:
    return df.agg(_ratio(relation_hit(pred, golds)).alias("relation_match"))


# --- tokenisers ------------------------------------------------------------

# Fixed patterns of the mteval-13a tokenizer (public BLEU tokenizer):
# symbols, period/comma not next to digits, dash after a digit.
_13A_RULES = [
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
]


#: white space as the tokenizers' split() sees it: Unicode spaces and U+001C to U+001F
_SPACE = r"(?U)[\s\x1c-\x1f]+"


def _split_ws(s: Column) -> Column:
    parts = F.split(F.trim(F.regexp_replace(s, _SPACE, " ")), " ")
    return F.filter(parts, lambda t: t != "")


def tok13a(c) -> Column:
    """M6: mteval-13a tokenisation -> array<string>; a null text has no tokens."""
    s = F.coalesce(_c(c), F.lit(""))
    for a, b in (("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"),
                 ("&lt;", "<"), ("&gt;", ">")):
        s = F.replace(s, F.lit(a), F.lit(b))
    s = F.concat(F.lit(" "), s, F.lit(" "))
    for pat, rep in _13A_RULES:
        s = F.regexp_replace(s, pat, rep)
    return _split_ws(s)


def tok_rouge(c) -> Column:
    """ROUGE tokenisation: lower case, non-[a-z0-9] runs become spaces; a null text has no tokens."""
    s = F.regexp_replace(F.lower(F.coalesce(_c(c), F.lit(""))), "[^a-z0-9]+", " ")
    return _split_ws(s)


#: tokens counted at once: bounds the memory of a batch of long texts (a longer row stands alone; see ``huge_chars``)
SLICE_TOKENS = 1 << 18
#: tokens of a piece of a huge text
PIECE_TOKENS = 1 << 16


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _slices(tokens: pa.Array, refs: pa.Array):
    """Runs of rows of at most ``SLICE_TOKENS`` tokens (one row at least)."""
    inner = np.concatenate([[0], np.cumsum(_lengths(refs.flatten()))])
    ends = np.concatenate([[0], np.cumsum(_lengths(refs))])
    total = np.cumsum(_lengths(tokens) + inner[ends[1:]] - inner[ends[:-1]])
    start = 0
    while start < len(tokens):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + SLICE_TOKENS, side="right")))
        yield tokens.slice(start, stop - start), refs.slice(start, stop - start)
        start = stop


def _overlaps(tokens: pa.Array, refs: pa.Array, max_n: int):
    """For n = 1 .. ``max_n``: (row of each reference, n-grams common to it and the row's ``tokens``, each as
    often as in both; per row the matches clipped by the best reference of each n-gram)."""
    lists, rows = refs.flatten(), len(tokens)
    owner = np.repeat(np.arange(rows), _lengths(refs))
    lengths = np.concatenate([_lengths(tokens), _lengths(lists)])
    filled = [x for x in (tokens.flatten(), lists.flatten()) if len(x)]        # empty arrays may come without offsets
    words = (pa.concat_arrays(filled) if filled else pa.array([], pa.string())).dictionary_encode()
    code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    side = np.repeat(np.arange(len(lengths)), lengths)          # 0 .. rows - 1: tokens, then the references
    left = np.cumsum(lengths)[side] - np.arange(len(code))
    at, gram = np.arange(len(code)), code
    for n in range(1, max_n + 1):
        if n > 1:
            keep = left[at] >= n
            at, gram = at[keep], gram[keep]
            gram = pd.factorize(gram * len(words.dictionary) + code[at + n - 1])[0].astype(np.int64)
        width = int(gram.max(initial=0)) + 1
        key, count = np.unique(side[at] * width + gram, return_counts=True)
        cut = int(np.searchsorted(key, rows * width))
        ref = key[cut:] // width - rows
        wanted = owner[ref] * width + key[cut:] % width          # the same n-gram among the row's tokens
        place = np.minimum(np.searchsorted(key[:cut], wanted), max(cut - 1, 0))
        mine = np.where(key[place] == wanted, count[place], 0) if cut else np.zeros(len(wanted), dtype=np.int64)
        hits = np.minimum(count[cut:], mine)
        order = np.argsort(wanted, kind="stable")
        first = np.flatnonzero(np.diff(wanted[order], prepend=-1))
        best = np.maximum.reduceat(hits[order], first) if len(first) else hits
        clipped = np.bincount(wanted[order][first] // width, best, rows).astype(np.int64)
        yield owner, np.bincount(ref, hits, len(owner)), clipped


def _struct(name_type: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in name_type])


def _clipped(max_n: int) -> Column:
    """Struct ``m1`` .. of the clipped matches of ``_p`` with ``_r``."""
    names = [f"m{n}" for n in range(1, max_n + 1)]

    @F.arrow_udf(_struct([(n, T.LongType()) for n in names]))
    def count(tokens: pa.Array, refs: pa.Array) -> pa.Array:
        parts = [[c for _, _, c in _overlaps(t, r, max_n)] for t, r in _slices(tokens, refs)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([[], *x]).astype(np.int64))
                                           for x in (zip(*parts) if parts else [[]] * max_n)], names)
    return count("_p", "_r")


def _rouge_n_struct(orders) -> Column:
    """Struct ``rouge<n>``: F1 of the best reference."""
    names = [f"rouge{n}" for n in orders]

    def scores(tokens: pa.Array, refs: pa.Array) -> list[np.ndarray]:
        size, ref_size, out = _lengths(tokens), _lengths(refs.flatten()), {}
        for n, (owner, hits, _) in enumerate(_overlaps(tokens, refs, max(orders)), 1):
            p = hits / np.maximum(size[owner] - n + 1, 1)
            r = hits / np.maximum(ref_size - n + 1, 1)
            out[n] = np.zeros(len(tokens))
            np.maximum.at(out[n], owner, np.divide(2 * p * r, p + r, out=np.zeros(len(p)), where=p + r > 0))
        return [out[n] for n in orders]

    @F.arrow_udf(_struct([(n, T.DoubleType()) for n in names]))
    def score(tokens: pa.Array, refs: pa.Array) -> pa.Array:
        parts = [scores(t, r) for t, r in _slices(tokens, refs)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([[], *x]))
                                           for x in (zip(*parts) if parts else [[]] * len(names))], names)
    return score("_p", "_r")


def _tokenised(df: DataFrame, keep: list, pred, refs, tok) -> DataFrame:
    """``keep`` with ``_p`` (tokens) and ``_r`` (tokens of each reference); null texts are empty, null
    ``refs`` no reference."""
    texts = F.coalesce(_c(refs), F.array().cast("array<string>"))
    return df.select(*keep, tok(pred).alias("_p"), F.transform(texts, tok).alias("_r"))


# --- huge texts -------------------------------------------------------------

def _huge(pred, refs, chars: int) -> Column:
    """Whether a row's texts together have more than ``chars`` characters."""
    sizes = F.transform(F.coalesce(_c(refs), F.array().cast("array<string>")), lambda r: F.coalesce(F.length(r), F.lit(0)).cast("long"))
    return F.coalesce(F.length(_c(pred)), F.lit(0)) + F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x) > chars


def _gram_at(n: int):
    return lambda i: F.struct(F.lit(n).alias("n"), F.array_join(F.slice("_t", i, n), " ").alias("gram"))


def _may_match(n: int):
    return lambda i: ~F.array_contains(F.slice("_t", i, n), -1)


def _coded(rows: DataFrame) -> DataFrame:
    """Tokens ``_p`` and ``_r`` as numbers within their row; -1 for those that the other side has not, whose n-grams can't match."""
    @F.arrow_udf("struct<p: array<int>, r: array<array<int>>>")
    def code(tokens: pa.Array, refs: pa.Array) -> pa.Array:
        out = [_row_codes(t, r) for t, r in _slices(tokens, refs)]
        kind = pa.struct([("p", pa.list_(pa.int32())), ("r", pa.list_(pa.list_(pa.int32())))])
        return pa.concat_arrays(out) if out else pa.array([], kind)
    coded = rows.withColumn("_c", code("_p", "_r"))
    return coded.select(*[c for c in rows.columns if c not in ("_p", "_r")], F.col("_c.p").alias("_p"), F.col("_c.r").alias("_r"))


def _row_codes(tokens: pa.Array, refs: pa.Array) -> pa.Array:
    lists, inner = refs.flatten(), _lengths(refs)
    n, each = _lengths(tokens), _lengths(lists)
    filled = [x for x in (tokens.flatten(), lists.flatten()) if len(x)]
    words = (pa.concat_arrays(filled) if filled else pa.array([], pa.string())).dictionary_encode()
    row = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.repeat(np.arange(len(n)), inner), each)])
    key = row * max(1, len(words.dictionary)) + words.indices.to_numpy(zero_copy_only=False)
    mine, theirs = key[:n.sum()], key[n.sum():]
    shared = np.intersect1d(mine, theirs)                     # by row, so a code is the place among the row's
    first = np.searchsorted(shared, np.arange(len(n)) * max(1, len(words.dictionary)))

    def lists_of(keys: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> pa.Array:
        at = np.minimum(np.searchsorted(shared, keys), max(len(shared) - 1, 0))
        codes = np.where(shared[at] == keys, at - first[rows], -1) if len(shared) else np.full(len(keys), -1)
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(codes, pa.int32()))
    p = lists_of(mine, row[:len(mine)], n)
    r = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(inner)]), pa.int32()), lists_of(theirs, row[len(mine):], each))
    return pa.StructArray.from_arrays([p, r], ["p", "r"])


def _gram_rows(texts: DataFrame, keys: list[str], tokens: str, max_n: int, piece: int) -> DataFrame:
    """``keys``, ``n``, ``gram``, ``c``: the n-grams of ``tokens`` of every order, counted.  A text is cut into ranges of
    ``piece`` tokens that overlap by ``max_n`` - 1, so the ranges of one text go to many tasks and each n-gram begins in one range.  Of ``_coded``
    tokens only n-grams that may match."""
    size, coded = F.size(tokens), isinstance(texts.schema[tokens].dataType.elementType, T.IntegerType)
    cut = texts.select(*keys, size.alias("_size"), tokens, F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(size / F.lit(piece)) - 1, F.lit(0)))).alias("_at"))
    cut = (cut.select(*keys, "_at", F.slice(tokens, (F.col("_at") * piece + 1).cast("int"), piece + max_n - 1).alias("_t"))
           .repartition(*keys, "_at"))                # ranges, not texts, are dealt to the tasks
    grams = []
    for n in range(1, max_n + 1):
        begins = F.least(F.size("_t") - (n - 1), F.lit(piece))
        at = F.when(begins > 0, F.sequence(F.lit(1), begins)).otherwise(F.array().cast("array<int>"))
        if coded:                                    # an n-gram with a token that the other side has not can't match
            at = F.filter(at, _may_match(n))
        grams.append(F.transform(at, _gram_at(n)))
    rows = cut.select(*keys, F.explode(F.concat(*grams)).alias("g")).select(*keys, "g.n", "g.gram")
    return rows.groupBy(*keys, "n", "gram").agg(F.count(F.lit(1)).alias("c"))


def _huge_overlaps(rows: DataFrame, max_n: int, piece: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``_row``, ``_p``, ``_r`` -> per row and order the matches clipped by the best reference (``_row``, ``n``, ``m``), and per
    reference those in common (``_row``, ``ref``, ``n``, ``m``, ``size``).  Counts meet by (row, n-gram) in a shuffle; no task holds a text's n-grams."""
    mine = _gram_rows(rows.select("_row", "_p"), ["_row"], "_p", max_n, piece)
    refs = rows.select("_row", F.posexplode("_r").alias("ref", "_t"))
    theirs = _gram_rows(refs.select("_row", "ref", F.col("_t").alias("_x")), ["_row", "ref"], "_x", max_n, piece).withColumnRenamed("c", "rc")
    both = mine.join(theirs, ["_row", "n", "gram"]).withColumn("hit", F.least("c", "rc"))
    clipped = both.groupBy("_row", "n", "gram").agg(F.max("hit").alias("hit")).groupBy("_row", "n").agg(F.sum("hit").alias("m"))
    common = both.groupBy("_row", "ref", "n").agg(F.sum("hit").alias("m"))
    orders = F.array(*[F.lit(n) for n in range(1, max_n + 1)])
    sizes = refs.select("_row", "ref", F.size("_t").alias("size"), F.explode(orders).alias("n"))
    return clipped, sizes.join(common, ["_row", "ref", "n"], "left").select("_row", "ref", "n", F.coalesce("m", F.lit(0)).alias("m"), "size")


# --- BLEU --------------------------------------------------------------------

def _bleu_columns(max_order: int = 4) -> list[Column]:
    tl = F.size("_p").cast("long")
    return ([tl.alias("tl"), F.coalesce(F.array_min(F.transform("_r", F.size)), F.lit(0)).cast("long").alias("rl")]
            + [F.greatest(tl - (k - 1), F.lit(0)).alias(f"poss{k}") for k in range(1, max_order + 1)]
            + [_clipped(max_order).alias("_m")])


def bleu_parts(df: DataFrame, pred="pred", refs="refs", id_col="id", by: list[str] | None = None,
               max_order: int = 4, huge_chars: int | None = None, piece: int = PIECE_TOKENS) -> DataFrame:
    """Per-row additive BLEU statistics: lengths, possible and clipped matches
    per order.  Summing them over any grouping and applying ``bleu_final``
    gives corpus BLEU for that group.  No shuffle; but rows with more than ``huge_chars`` characters, if that is given, are cut
    into ranges of ``piece`` tokens whose n-gram counts are shuffled, so that one huge text is many tasks' work."""
    keys = [*(by or []), id_col]

    def at_once(rows: DataFrame) -> DataFrame:
        return _tokenised(rows, keys, pred, refs, tok13a).select(*keys, *_bleu_columns(max_order)).select("*", "_m.*").drop("_m")

    if huge_chars is None:
        return at_once(df)
    huge = _huge(pred, refs, huge_chars)
    rows = _numbered(_coded(_tokenised(df.where(huge), keys, pred, refs, tok13a)))
    clipped, _ = _huge_overlaps(rows, max_order, piece)
    m = clipped.groupBy("_row").agg(*[F.sum(F.when(F.col("n") == k, F.col("m"))).alias(f"m{k}") for k in range(1, max_order + 1)])
    lengths = rows.select("_row", *keys, *_bleu_columns(max_order)[:-1])
    long = lengths.join(m, "_row", "left").select(*lengths.columns[1:], *[F.coalesce(f"m{k}", F.lit(0)).cast("long").alias(f"m{k}") for k in range(1, max_order + 1)])
    return at_once(df.where(~huge)).unionByName(long)


def _numbered(rows: DataFrame) -> DataFrame:
    """Tokenised rows with a number ``_row``, fixed by a checkpoint: two plans read them."""
    ensure_checkpoint_dir(rows.sparkSession)
    return rows.withColumn("_row", F.monotonically_increasing_id()).checkpoint()


def bleu_sums(max_order: int = 4) -> list[Column]:
    return ([F.sum("tl").alias("translation_length"), F.sum("rl").alias("reference_length")]
            + [F.sum(f"poss{k}").alias(f"poss{k}") for k in range(1, max_order + 1)]
            + [F.sum(f"m{k}").alias(f"m{k}") for k in range(1, max_order + 1)])


def bleu_final(agg: DataFrame, keep: list[str], max_order: int = 4, detail: bool = False) -> DataFrame:
    prec = [F.when(F.col(f"poss{k}") > 0, F.col(f"m{k}") / F.col(f"poss{k}")).otherwise(F.lit(0.0))
            for k in range(1, max_order + 1)]
    out = agg.select(*keep, "translation_length", "reference_length",
                     *[p.alias(f"precision_{k}") for k, p in enumerate(prec, 1)])
    ps = [F.col(f"precision_{k}") for k in range(1, max_order + 1)]
    geo = F.when(F.least(*ps) > 0, F.exp(sum(F.log(p) for p in ps) / max_order)).otherwise(F.lit(0.0))
    ratio = F.try_divide(F.col("translation_length").cast("double"), F.col("reference_length").cast("double"))
    bp = F.when(ratio > 1.0, F.lit(1.0)).otherwise(F.exp(1 - F.try_divide(F.lit(1.0), ratio)))
    out = (out.withColumn("length_ratio", ratio).withColumn("brevity_penalty", bp)
           .withColumn("bleu", F.col("brevity_penalty") * geo))
    if detail:
        return out.select(*keep, "bleu", *[f"precision_{k}" for k in range(1, max_order + 1)],
                          "brevity_penalty", "length_ratio", "translation_length", "reference_length")
    return out.select(*keep, "bleu")


def bleu(df: DataFrame, pred="pred", refs="refs", id_col="id", by: list[str] | None = None,
         max_order: int = 4, detail: bool = False, huge_chars: int | None = None, piece: int = PIECE_TOKENS) -> DataFrame:
    """M4 / M5: corpus BLEU with several references (clipped n-gram precision
    summed over the corpus, brevity penalty against the shortest reference,
    no smoothing).  ``by`` scores several runs in one pass.  ``detail`` adds
    the precisions, brevity penalty, length ratio and lengths; ``huge_chars`` as in ``bleu_parts``."""
    by = list(by or [])
    parts = bleu_parts(df, pred, refs, id_col, by, max_order, huge_chars, piece)
    return bleu_final(parts.groupBy(*by).agg(*bleu_sums(max_order)), by, max_order, detail)


# --- ROUGE -------------------------------------------------------------------

def rouge_n(df: DataFrame, pred="pred", refs="refs", id_col="id", orders=(1, 2),
            by: list[str] | None = None, huge_chars: int | None = None, piece: int = PIECE_TOKENS) -> DataFrame:
    """M7 per row: ROUGE-N F1 against the best reference (per N), no stemming, any N; ``huge_chars`` as in ``bleu_parts``."""
    keys = [*(by or []), id_col]

    def at_once(rows: DataFrame) -> DataFrame:
        return _tokenised(rows, keys, pred, refs, tok_rouge).select(*keys, _rouge_n_struct(orders).alias("_s")).select(*keys, "_s.*")

    if huge_chars is None:
        return at_once(df)
    huge = _huge(pred, refs, huge_chars)
    rows = _numbered(_coded(_tokenised(df.where(huge), keys, pred, refs, tok_rouge)))
    _, per_ref = _huge_overlaps(rows, max(orders), piece)
    scored = per_ref.join(rows.select("_row", F.size("_p").alias("mine")), "_row")
    p = F.col("m") / F.greatest(F.col("mine") - F.col("n") + 1, F.lit(1))
    r = F.col("m") / F.greatest(F.col("size") - F.col("n") + 1, F.lit(1))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    best = scored.withColumn("f", f).groupBy("_row").agg(*[F.max(F.when(F.col("n") == n, F.col("f"))).alias(f"rouge{n}") for n in orders])
    long = rows.select("_row", *keys).join(best, "_row", "left").select(*keys, *[F.coalesce(f"rouge{n}", F.lit(0.0)).alias(f"rouge{n}") for n in orders])
    return at_once(df.where(~huge)).unionByName(long)


def _places(b: list) -> dict:
    where: dict = {}
    for j, y in enumerate(b):
        where[y] = where.get(y, 0) | 1 << j
    return where


def _lcs_rows(a: list, where: dict, v: int, full: int):
    """Rows of the longest-common-subsequence table as bit vectors (Python integers): after token i of
    ``a``, bit j is 0 where the length grows at token j of ``b`` (``where``: bits of each of its tokens).  One word operation covers many
    cells; ``v`` is the row before the first."""
    for x in a:
        hit = v & where.get(x, 0)
        v = ((v + hit) | (v - hit)) & full
        yield v


def _lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    full = v = (1 << len(b)) - 1
    for v in _lcs_rows(a, _places(b), full, full):
        pass
    return len(b) - v.bit_count()


def _union_lcs_len(ref_sents, pred_sents) -> int:
    """Summary-level LCS of ROUGE-Lsum: for each reference sentence the union of
    its LCS tokens with every prediction sentence, counted with clipping."""
    from collections import Counter
    pc = Counter(t for s in pred_sents for t in s)
    rcnt = Counter(t for s in ref_sents for t in s)
    hits = 0
    for r in ref_sents:
        union = set()
        for p in pred_sents:
            union |= set(_lcs_positions(r, p))
        for i in sorted(union):
            t = r[i]
            if pc[t] > 0 and rcnt[t] > 0:
                hits += 1
                pc[t] -= 1
                rcnt[t] -= 1
    return hits


def _lcs_positions(a: list, b: list) -> list[int]:
    """Places in ``a`` of one longest common subsequence: from the end, equal tokens pair up; otherwise
    ``a`` is shortened unless that loses length.

    The table is never held: one row in sqrt(len(a)) is kept on the way forward, and a stretch between two of them is made
    again when the way back comes to it.  That is 2 sqrt(n) rows of m bits, and the work twice that of the length alone; common ends, which pair up
    whatever lies between, are taken off first."""
    n, m = len(a), len(b)
    tail = 0
    while tail < min(n, m) and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    out, i, j = list(range(n - 1, n - 1 - tail, -1)), n - tail, m - tail
    if not i or not j:
        return out[::-1]
    step, where, full = max(1, math.isqrt(i)), _places(b[:j]), (1 << j) - 1
    kept, v = [full], full
    for k, v in enumerate(_lcs_rows(a[:i], where, full, full), 1):
        if k % step == 0:
            kept.append(v)
    low, rows = i + 1, []                        # rows of the stretch that begins at row ``low``
    while i > 0 and j > 0:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
            continue
        if i - 1 < low:                          # rows i - 1 and i lie in one stretch
            low = (i - 1) // step * step
            rows = [kept[low // step], *_lcs_rows(a[low:min(i, low + step)], where, kept[low // step], full)]
        cells = (1 << j) - 1
        if (rows[i - 1 - low] & cells).bit_count() == (rows[i - low] & cells).bit_count():
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _f(p, r):
    return 0.0 if p + r == 0 else 2 * p * r / (p + r)


def _plain(c) -> Column:
    """The text with everything but ROUGE tokens and line ends made a space; null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9\n]+", " ")


_ROUGE_L = T.StructType([T.StructField("rougeL", T.DoubleType()), T.StructField("rougeLsum", T.DoubleType())])


@F.pandas_udf(_ROUGE_L)
def _rouge_l_udf(pred: pd.Series, refs: pd.Series) -> pd.DataFrame:
    def sentences(text):
        return [t for t in (line.split() for line in text.split("\n")) if t]

    rows = []
    for p, rs in zip(pred, refs):
        ps, best, best_sum = sentences(p), 0.0, 0.0
        pt = [t for s in ps for t in s]
        for r in rs:
            refs_s = sentences(r)
            rt = [t for s in refs_s for t in s]
            if pt and rt:
                lcs, union = _lcs(rt, pt), _union_lcs_len(refs_s, ps)
                best = max(best, _f(lcs / len(pt), lcs / len(rt)))
                best_sum = max(best_sum, _f(union / len(pt), union / len(rt)))
        rows.append((best, best_sum))
    return pd.DataFrame(rows, columns=["rougeL", "rougeLsum"], dtype="float64")


def _rouge_l_column(pred, refs) -> Column:
    texts = F.coalesce(_c(refs), F.array().cast("array<string>"))
    return _rouge_l_udf(_plain(_c(pred)), F.transform(texts, _plain))


def rouge_scores(df: DataFrame, pred="pred", refs="refs", keep: list[str] | None = None,
                 lcs: bool = True) -> DataFrame:
    """M7 + M8 per row: ROUGE-1, ROUGE-2 and (with ``lcs``) ROUGE-L and ROUGE-Lsum F1, each against its
    best reference; no shuffle."""
    keep = list(keep or [])
    extra = [_rouge_l_column(pred, refs).alias("_l")] if lcs else []
    rows = _tokenised(df, [*keep, *extra], pred, refs, tok_rouge).select(*keep, _rouge_n_struct((1, 2)).alias("_s"), *(["_l"] if lcs else []))
    return rows.select(*keep, "_s.*", *(["_l.*"] if lcs else []))


def rouge_l(df: DataFrame, pred="pred", refs="refs", keep: list[str] | None = None) -> DataFrame:
    """M8 per row: ROUGE-L and ROUGE-Lsum F1 (best reference)."""
    keep = list(keep or [])
    return df.select(*keep, _rouge_l_column(pred, refs).alias("_l")).select(*keep, "_l.*")


def rouge_summary(per_row: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """Mean F1 in percent, 4 decimals (plain mean; the reference's library
    reports a bootstrap median, a documented deviation)."""
    by = list(by or [])
    return per_row.groupBy(*by).agg(*[F.round(F.avg(c) * 100, 4).alias(c) for c in cols])


# --- other metrics -----------------------------------------------------------

def gen_len(ids, pad_id: int) -> Column:
    """M9 row part: number of non-pad tokens."""
    return F.size(F.filter(_c(ids), lambda x: x != F.lit(pad_id)))


def unmask_labels(ids, pad_id: int) -> Column:
    """-100 -> pad id."""
    return F.transform(_c(ids), lambda x: F.when(x == -100, F.lit(pad_id)).otherwise(x))


def score_run(df: DataFrame, pred="pred", golds="golds", by: list[str] | None = None) -> DataFrame:
    """One row per run -- accuracy, BLEU, skeleton match, relation match.
    Every part is an additive per-row statistic: one projection computes the
    match flags and the BLEU statistics of a row together (no join), and one
    aggregate sums them per run."""
    by = list(by or [])
    flags = [exact_hit(pred, golds).cast("double").alias("h_exact"),
             skeleton_hit(pred, golds).cast("double").alias("h_skel"),
             relation_hit(pred, golds).cast("double").alias("h_rel")]
    kept = [*by, "h_exact", "h_skel", "h_rel"]
    rows = _tokenised(df, [*by, *flags], pred, golds, tok13a).select(*kept, *_bleu_columns()).select("*", "_m.*").drop("_m")
    agg = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.sum("h_exact").alias("_e"),
                                F.sum("h_skel").alias("_s"), F.sum("h_rel").alias("_r"), *bleu_sums())
    agg = (agg.withColumn("accuracy", F.try_divide("_e", "_n")).withColumn("skeleton_match", F.try_divide("_s", "_n"))
           .withColumn("relation_match", F.try_divide("_r", "_n")))
    return bleu_final(agg, by + ["accuracy", "skeleton_match", "relation_match"])


def score_retrieval(df: DataFrame, pred="pred", golds="golds", by: list[str] | None = None, lcs: bool = True) -> DataFrame:
    """M11, retrieval report: one row per run -- accuracy, corpus BLEU with its parts, mean ROUGE F1 in
    percent (without ``lcs`` only ROUGE-1 and -2).  One pass over the rows and one aggregate."""
    by = list(by or [])
    kinds = ["rouge1", "rouge2"] + (["rougeL", "rougeLsum"] if lcs else [])
    src = df.select(*by, _c(pred).alias("_pred"), _c(golds).alias("_golds"))
    hit = exact_hit("_pred", "_golds").cast("double").alias("_h")
    rows = _tokenised(src, [*by, "_pred", "_golds", hit], "_pred", "_golds", tok13a)
    rows = rows.select(*by, "_pred", "_golds", "_h", *_bleu_columns()).select("*", "_m.*").drop("_m")
    stats = [c for c in rows.columns if c not in ("_pred", "_golds")]
    rows = rouge_scores(rows, "_pred", "_golds", stats, lcs)
    agg = rows.groupBy(*by).agg(F.avg("_h").alias("accuracy"), *[F.round(F.avg(k) * 100, 4).alias(k) for k in kinds], *bleu_sums())
    return bleu_final(agg, [*by, "accuracy", *kinds], detail=True)


def conversion_rate(valid) -> Column:
    """Failing conversions count as empty output and stay in the
    denominator."""
    return F.avg(F.coalesce(_c(valid), F.lit(False)).cast("double"))


def unmask_label(c, pad_id: int) -> Column:
    """M10 on one token column: -100 -> pad id."""
    return F.when(_c(c) == -100, F.lit(pad_id)).otherwise(_c(c))


def count_non_pad(c, pad_id: int) -> Column:
    """M9 as an aggregate over token rows: number of non-pad tokens."""
    return F.count_if(_c(c) != F.lit(pad_id))
