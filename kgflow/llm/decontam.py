"""Op 4: benchmark decontamination by template canonicalisation.

Texts become template tokens: words are stripped of outer punctuation and lower-cased;
numbers (in digits or written out in English, German, French or Spanish), names (capitalised words inside a sentence) and units become the
typed placeholders NUM, NAME and UNIT, whose surface forms are kept as slot values.  A capitalised word at a sentence's
start may be a name or not and is read both ways: a document's windows with all of them as literals and
with all as names, an item's in every combination; so what precedes a copy does not matter.  A document is
contaminated by an item if windows of ``window`` template tokens match, the slot values of the
matched windows agree, and the matched windows cover enough of the item.

1. The benchmark's windows (a shorter item is one window) are made like the documents' and staged.
   Those with at least ``min_literals`` literal tokens match by template, thin ones by their words and
   slot values as they are (also those thin only with all doubtful words as names), so every item has windows
   over all its tokens.
2. Their hashes fill a Bloom filter of fixed size, which every task over the documents holds;
   only document windows that may match leave the task, with their template and slots.
   A larger benchmark lets more through, nothing less.
3. Those windows meet the benchmark's in an exact equi-join on hash and template.
4. Matches are grouped by document, item and alignment (document position less item position)
   and the slots checked: within an alignment one benchmark value of a type always stands for the same
   document value and the other way round.  Alignments that fail are cut down to
   their largest consistent run of windows, so a true copy beside a chance match still counts.
5. A document (id and text; equal rows once) is reported for an item if consistent windows cover ``min_cover`` template tokens of it,
   or the whole item if that is shorter.

Cases: null and empty texts match nothing; ids may be null or repeated (``k1``, ``k2`` name the
text); items without a token are never found, items
shorter than ``min_literals`` with a slot only as they are; an empty table or benchmark gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgflow.llm.common import fresh, key128, staged, text_or_empty

WINDOW, MIN_LITERALS, MIN_COVER = 8, 5, 13
BLOOM_BITS = 22                      # 2^22 bits, 512 KB
CACHE = 1 << 18
CHUNK = 1 << 19                      # characters read side by side
LITERAL, NUM, NAME, UNIT = 0, 1, 2, 3
KINDS = ("", "NUM", "NAME", "UNIT")
# fixed values: common unit names and signs
UNITS = frozenset("""mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres
kilometer kilometers kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms ton tons tonne tonnes pound
pounds ounce ounces ml l liter liters litre litres gallon gallons s sec secs second seconds min mins minute minutes
h hr hrs hour hours day days week weeks month months year years mph kmh km/h m/s hz khz mhz ghz w kw mw v kv a ma j kj kcal cal
pa kpa bar c f k °c °f % percent $ € £ dollar dollars euro euros cent cents usd eur gbp""".split())
# fixed values: number words of four languages; words that are also articles, pronouns or other words (one, ein, un, uno, neuf, once, elf, cent, null) are not among them
NUMBER_WORDS = frozenset("""zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen
nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen
zwei drei vier fünf sechs sieben acht neun zehn zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig dreißig vierzig
fünfzig sechzig siebzig achtzig neunzig hundert tausend million millionen dutzend
zéro deux trois quatre cinq sept huit dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante mille
million millions milliard milliards douzaine
cero dos tres cuatro cinco seis siete ocho nueve diez doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte treinta cuarenta
cincuenta sesenta setenta ochenta noventa cien ciento mil millón millones docena""".split())
GERMAN = re.compile(r"(?:ein|zwei|drei|vier|fünf|sechs|sieben|acht|neun)und(?:zwanzig|dreißig|vierzig|fünfzig|sechzig|siebzig|achtzig|neunzig)")
KIND_HASHES = [xxhash.xxh64_intdigest(f"{k}\x00") for k in KINDS]
NAME_HASH = np.uint64(KIND_HASHES[NAME])
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:e[+-]?\d+)?%?", re.I)
EDGE = re.compile(r"^[^\w$€£%°+-]+|[^\w$€£%°]+$")
THIN = np.uint64(0xD1B54A32D192ED03)
MULT = np.uint64(0x9E3779B97F4A7C15)


def is_number_word(low: str) -> bool:
    """A number written out: one word, a compound with hyphens (twenty-one, vingt-et-un), or a German compound."""
    if low in NUMBER_WORDS or "und" in low and GERMAN.fullmatch(low):
        return True
    if "-" not in low:
        return False
    parts = low.split("-")
    return len(parts) > 1 and parts[0] in NUMBER_WORDS and all(p in NUMBER_WORDS or p in ("one", "et", "un", "y", "neuf") for p in parts)


def _word(raw: str):
    """(kind if not a name, form, capitalised, ends a sentence) of a raw word; no form: not a token."""
    form, ends = raw, False
    if not raw.isalpha():
        form = raw[:-1] if raw[:-1].isalpha() and raw[-1] in ".,;:!?" else EDGE.sub("", raw)
        ends = raw[-1:] in ".!?:;\"”»)\x00"
    low = form.lower()
    if is_number_word(low):
        return NUM, low, False, ends
    if form.isalpha():
        return (UNIT if low in UNITS else LITERAL), low, form[0].isupper() and form[1:].islower(), ends
    if not any(map(str.isalnum, form)) and form not in UNITS:
        return LITERAL, "", False, ends
    if NUMBER.fullmatch(form):
        return NUM, low, False, ends
    return (UNIT if low in UNITS else LITERAL), low, form[0].isupper() and form[1:].islower(), ends


class Canon:
    """Texts -> template tokens; words are looked up in a bounded table of numpy columns."""

    def __init__(self):
        self.ids: dict[str, int] = {}
        self.clear()

    def clear(self):
        self.ids.clear()
        self.forms, self._cols = [], tuple(np.zeros(0, dtype=t) for t in (np.int8, bool, bool, np.uint64, np.uint64, bool))

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The numbers of different words; new ones are added."""
        known = len(self.ids)
        out = np.fromiter(map(self.ids.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        at = np.flatnonzero(out < 0)
        if len(at):
            new = words[at].tolist()
            out[at] = np.arange(known, known + len(at))
            self.ids.update(zip(new, range(known, known + len(at)), strict=True))
            kinds, forms, caps, ends = zip(*map(_word, new), strict=True)
            self.forms += forms
            kinds, full = np.array(kinds, dtype=np.int8), np.fromiter(map(len, forms), dtype=np.int64, count=len(at)) > 0
            exact = np.fromiter((xxhash.xxh64_intdigest("\x00" + f) for f in forms), dtype=np.uint64, count=len(at))
            hashes = np.where(kinds > 0, np.array(KIND_HASHES, dtype=np.uint64)[kinds], exact)
            cols = kinds, np.array(caps, dtype=bool), np.array(ends, dtype=bool), hashes, exact, full
            self._cols = tuple(np.concatenate(c) for c in zip(self._cols, cols, strict=True))
        return out

    def together(self, texts: list[str]) -> tuple[tuple, np.ndarray]:
        """The texts' tokens one text after the other: the word table's forms, the words' numbers in it, kinds, hashes, hashes of the forms
        and whether it may as well be a name; and where each text begins, with the end of the last.
        A unit is one only after a number."""
        if len(self.ids) > CACHE:
            self.clear()
        # a line's start is a sentence's; a text that begins or ends with white space has an empty word there, which is no token
        rows = pc.utf8_split_whitespace(pa.array([text.replace("\n", " \x00 ") for text in texts], pa.string()))
        bounds, words = rows.offsets.to_numpy().astype(np.int64), rows.values.dictionary_encode()
        at = self.numbers(words.dictionary.to_numpy(zero_copy_only=False))[words.indices.to_numpy()]
        all_kinds, all_caps, all_ends, all_hashes, all_exact, all_full = self._cols
        full = all_full[at]
        first = _after(all_ends[at], bounds, True)[full]
        bounds = np.r_[0, np.cumsum(full)][bounds]
        at = at[full]
        kinds, exact, caps = all_kinds[at], all_exact[at], all_caps[at] & (all_kinds[at] == LITERAL)
        either = caps & first
        name = caps & ~first
        kinds[name] = NAME
        hashes = all_hashes[at]
        hashes[name] = NAME_HASH
        loose = np.flatnonzero((kinds == UNIT) & ~_after(kinds == NUM, bounds, False))
        hashes[loose] = exact[loose]
        kinds[loose] = LITERAL
        return (self.forms, at, kinds, hashes, exact, either), bounds

    def tokens(self, texts: list[str]) -> Iterator[tuple]:
        """Each text's tokens."""
        (forms, *cols), bounds = self.together(texts)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            yield forms, *(c[lo:hi] for c in cols)


def _after(flags: np.ndarray, bounds: np.ndarray, start: bool) -> np.ndarray:
    """The flag of the place before each place, ``start`` for a text's first."""
    out = np.empty(len(flags), dtype=bool)
    out[1:] = flags[:-1]
    out[bounds[:-1][bounds[:-1] < bounds[1:]]] = start
    return out


def _sum(hashes: np.ndarray, w: int) -> np.ndarray:
    """Sum of hash i of each window times MULT to the power w - 1 - i, by halves."""
    if w == 1:
        return hashes
    half = w // 2 if w % 2 == 0 else 1
    left = _sum(hashes, w - half)
    right = left if half == w - half else hashes
    return left[:len(hashes) - w + 1] * np.uint64(pow(int(MULT), half, 1 << 64)) + right[w - half:]


def _roll(hashes: np.ndarray, w: int) -> np.ndarray:
    out = _sum(hashes, w).copy()
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


PLAIN, NAMED, EXACT = 0, 1, 2        # readings of a window: doubtful words as literals, some as names, thin


def _sums(flags: np.ndarray, w: int) -> np.ndarray:
    n = np.r_[0, np.cumsum(flags)]
    return n[w:] - n[:-w]


def windows(tokens, w: int, min_literals: int, bounds: np.ndarray | None = None):
    """Start, hash and reading of the windows of ``w`` tokens, doubtful words all as literals and all as names; of several
    texts together the windows within each (``bounds`` as from ``Canon.together``)."""
    _, _, kinds, hashes, exact, either = tokens
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)
    if len(kinds) < w or w < 1:
        return none
    within = np.ones(len(kinds) - w + 1, dtype=bool)
    if bounds is not None:
        for j in range(1, w):                # the windows that begin j places before another text
            cut = bounds[1:-1] - j
            within[cut[(cut >= 0) & (cut < len(within))]] = False
    need = min(min_literals, w)
    lit, names = _sums(kinds == LITERAL, w), _sums(either, w)
    out = []
    sure = lit - names >= need
    for reading, ok, of in ((PLAIN, lit >= need, hashes), (NAMED, (names > 0) & sure, np.where(either, NAME_HASH, hashes)),
                            (EXACT, ~sure, exact)):
        at = np.flatnonzero(ok & within)
        if reading == EXACT and 8 * len(at) < len(ok):         # few: roll them alone
            if len(at):
                h = _roll(exact[at[:, None] + np.arange(w)].ravel(), w)[::w]
                out.append((at, h ^ THIN, np.full(len(at), reading, dtype=np.int8)))
        elif len(at):
            h = _roll(of, w)[at]
            out.append((at, h ^ THIN if reading == EXACT else h, np.full(len(at), reading, dtype=np.int8)))
    return tuple(map(np.concatenate, zip(*out, strict=True))) if out else none


def all_windows(tokens, w: int, min_literals: int) -> Iterator[tuple]:
    """Start, hash, reading and kinds of the windows of an item, doubtful words in every combination."""
    at, h, reading = windows(tokens, w, min_literals)
    _, _, kinds, hashes, _, either = tokens
    for s, x, r in zip(at, h, reading, strict=True):
        yield s, x, r, np.where(either, NAME, kinds) if r == NAMED else kinds
    for s in range(len(kinds) - w + 1):
        doubtful = s + np.flatnonzero(either[s:s + w])
        for some in chain.from_iterable(combinations(doubtful, n) for n in range(1, len(doubtful))):       # none and all are above
            k, z = kinds.copy(), hashes[s:s + w].copy()
            k[list(some)] = NAME
            z[np.array(some) - s] = NAME_HASH
            if (k[s:s + w] == LITERAL).sum() >= min(min_literals, w):
                yield s, _roll(z, w)[0], NAMED, k


def _describe(tokens, kinds, s: int, w: int, reading: int):
    forms, at = tokens[:2]
    part = [(KINDS[k], forms[i]) for i, k in zip(at[s:s + w], kinds[s:s + w], strict=True)]
    if reading == EXACT:           # only numbers are slots wherever the window stands
        return "= " + " ".join(f for _, f in part), [f"{k}={f}" for k, f in part if k == "NUM"]
    return " ".join(k or f for k, f in part), [f"{k}={f}" for k, f in part if k]


WINDOWS = "pos int, w int, h long, reading byte, template string, slots array<string>"


def bench_windows(bench: DataFrame, id_col: str, text_col: str, w: int, min_literals: int) -> DataFrame:
    """``item``, ``n_tokens`` and the windows of every item."""
    rows = bench.select(bench[id_col].alias("item"), text_or_empty(bench, text_col).alias("t"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = Canon()
        for pdf in batches:
            out = []
            for item, tok in zip(pdf["item"], canon.tokens(pdf["t"].tolist()), strict=True):
                n = min(w, len(tok[1]))
                out += [(item, len(tok[1]), int(s), n, int(x.view(np.int64)), r, *_describe(tok, k, s, n, r)) for s, x, r, k in all_windows(tok, n, min_literals)]
            yield pd.DataFrame(out, columns=["item", "n_tokens", "pos", "w", "h", "reading", "template", "slots"])
    return rows.mapInPandas(run, rows.select("item").schema.simpleString()[7:-1] + ",n_tokens int," + WINDOWS)


def _probes(h: np.ndarray):
    return h & np.uint64((1 << BLOOM_BITS) - 1), (h >> np.uint64(32)) & np.uint64((1 << BLOOM_BITS) - 1)


def _maybe(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter may hold."""
    at = np.arange(len(h))
    for k in (0, 1):
        b = _probes(h[at] if k else h)[k]
        at = at[(words[b >> np.uint64(6)] >> (b & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return at


def _bloom(spark, wins: DataFrame):
    """Filter words (64 bits each) of the window hashes: at most 2^(BLOOM_BITS - 6) rows."""
    mask = (1 << BLOOM_BITS) - 1
    bits = wins.select(F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("b"))
    rows = (bits.select(F.shiftright("b", 6).alias("at"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("b").bitwiseAND(63).cast("int")).alias("bit"))
            .groupBy("at").agg(F.bit_or("bit").alias("bits")).collect())
    words = np.zeros(1 << (BLOOM_BITS - 6), dtype=np.int64)
    for r in rows:
        words[r["at"]] = r["bits"]
    return spark.sparkContext.broadcast(words.view(np.uint64))


def _chunks(names: list, texts: dict) -> Iterator[list]:
    """The names in parts of about ``CHUNK`` characters."""
    part, size = [], 0
    for k in names:
        part.append(k)
        size += len(texts[k])
        if size >= CHUNK:
            yield part
            part, size = [], 0
    if part:
        yield part


def doc_windows(rows: DataFrame, bloom, lengths: list[int], min_literals: int) -> DataFrame:
    """``id``, ``k1``, ``k2``, ``t`` -> windows that may be the benchmark's."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, canon = bloom.value, Canon()
        for pdf in batches:
            out, keys = [], list(zip(pdf["k1"], pdf["k2"], strict=True))
            known = dict(zip(keys, pdf["t"], strict=True))              # copies within a batch once
            names = list(known)
            for part in _chunks(names, known):
                tok, bounds = canon.together([known[k] for k in part])
                kinds = tok[2], np.where(tok[5], NAME, tok[2]), tok[2]
                for k in part:
                    known[k] = []
                for w in lengths:
                    at, h, reading = windows(tok, w, min_literals, bounds)
                    hit = _maybe(words, h)
                    at, h, reading = at[hit], h[hit].view(np.int64), reading[hit]
                    of = np.searchsorted(bounds, at, side="right") - 1
                    for s, x, r, i in zip(at, h, reading, of, strict=True):
                        known[part[i]].append((int(s - bounds[i]), w, int(x), r, *_describe(tok, kinds[r], s, w, r)))
            for i, (k1, k2) in zip(pdf["id"], keys, strict=True):
                out += [(i, k1, k2, *f) for f in known[k1, k2]]
            f = pd.DataFrame(out, columns=["id", "k1", "k2", "pos", "w", "h", "reading", "template", "slots"])
            f["id"] = f["id"].astype(pdf["id"].dtype)
            yield f
    return rows.mapInPandas(run, rows.select("id").schema.simpleString()[7:-1] + ",k1 long,k2 long," + WINDOWS)


def consistent(pairs: list[tuple[str, str]]) -> bool:
    """Whether (benchmark slot, document slot) pairs map one to one."""
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    return all(there.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in pairs)


def covered(matches: list[tuple[int, int, list[str], list[str]]]) -> set[int]:
    """Item tokens covered by windows of one alignment whose slots agree: all windows, or
    the largest run of neighbouring ones.  ``matches``: (item position, width, benchmark slots,
    document slots)."""
    matches = sorted(matches, key=lambda m: m[0])

    def agree(part):
        return consistent([p for m in part for p in zip(m[2], m[3], strict=True)])

    def tokens(part):
        return {x for m in part for x in range(m[0], m[0] + m[1])}

    if agree(matches):
        return tokens(matches)
    best, start = set(), 0
    for stop in range(1, len(matches) + 1):
        while start < stop and not agree(matches[start:stop]):
            start += 1
        best = max(best, tokens(matches[start:stop]), key=len)
    return best


def contaminated(docs: DataFrame, bench: DataFrame, window: int = WINDOW, min_literals: int = MIN_LITERALS, min_cover: int = MIN_COVER,
                 id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``id``, ``k1``, ``k2``, ``item``, ``n_covered``, ``n_tokens`` (of the item), ``exact`` (some alignment
    differs in no slot) per distinct document (id and text) and item that it contains."""
    spark = docs.sparkSession
    items = staged(bench_windows(bench, item_col, item_text_col, window, min_literals), "bench-windows")
    lengths = sorted(r.w for r in items.select("w").distinct().collect())        # window and shorter: at most ``window`` numbers
    text = text_or_empty(docs, text_col)
    rows = docs.select(docs[id_col].alias("id"), *key128(text), text.alias("t"))
    found = doc_windows(rows, _bloom(spark, items), lengths, min_literals)
    b = items.select("item", "n_tokens", F.col("reading").alias("item_reading"), F.col("pos").alias("item_pos"), "h", "template", F.col("slots").alias("item_slots"))
    hits = found.join(b, ["h", "template"])           # the template tells exact windows from others
    # rows of equal id and text are one case; each row is reported below
    per = hits.groupBy("id", "k1", "k2", "item", "n_tokens", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(
        F.collect_set(F.struct("item_pos", "w", "item_slots", "slots",
                             ((F.col("reading") == PLAIN) & (F.col("item_reading") == PLAIN)).alias("plain"))).alias("m"))

    @F.pandas_udf("cover array<int>, exact boolean")
    def check(m: pd.Series) -> pd.DataFrame:
        out = []
        for ms in m:
            plain = [x["plain"] for x in ms]
            ms = [(x["item_pos"], x["w"], list(x["item_slots"]), list(x["slots"])) for x in ms]
            # a clash with another reading takes nothing from the plain one
            best = max(covered(ms), covered([x for x, p in zip(ms, plain, strict=True) if p]), key=len)
            out.append((sorted(best), all(x[2] == x[3] for x in ms)))
        return pd.DataFrame(out, columns=["cover", "exact"])

    per = per.select("id", "k1", "k2", "item", "n_tokens", check("m").alias("c"))
    # alignments of one item add up (a copy with a word put in); an item is a bounded text
    best = per.groupBy("id", "k1", "k2", "item", "n_tokens").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("c.cover")))).alias("n_covered"), F.bool_or("c.exact").alias("exact"))
    return (best.where(F.col("n_covered") >= F.least(F.lit(min_cover), F.col("n_tokens")))
            .select("id", "k1", "k2", "item", "n_covered", "n_tokens", "exact"))


def decontaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    i, a, b = fresh(docs, "_id", "_k1", "_k2")
    bad = contaminated(docs, bench, id_col=id_col, text_col=text_col, **params)
    bad = staged(bad.select(F.col("id").alias(i), F.col("k1").alias(a), F.col("k2").alias(b)).distinct(), "contaminated")
    k1, k2 = key128(text_or_empty(docs, text_col))
    return docs.join(bad, (k1 == F.col(a)) & (k2 == F.col(b)) & docs[id_col].eqNullSafe(F.col(i)), "left_anti").select(*docs.columns)
