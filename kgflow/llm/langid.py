"""Op 9: language identification by a bidirectional gated recurrent network over bytes.

The network reads UTF-8 bytes in windows of ``WINDOW`` bytes, one gated recurrent layer in each
direction; every position gets a probability for every language, and a document's
probability is the mean over all its positions, whatever its length.

Training: numpy, back-propagation through time, Adam, on the driver, on a sample bounded by
``PER_LANG`` documents a language (the smallest hashes of their ids) and ``SLICE`` characters each,
from documents whose crc32(doc_id) mod 3 is not 1 and whose lang is set; only their text and
lang are used.  Seeds are fixed, so reruns agree.

Prediction: one pass over the documents in Arrow batches, windows of many documents side by side;
no shuffle.  Memory: one Arrow batch and one block of windows.

Cases: null text or no letter: ``und`` with score 0; nothing to learn from (no labels,
empty table): all ``und``; a null id is not held out and not learned from; repeated rows are
all predicted; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgflow.llm.common import fresh, text_or_empty

HIDDEN, WINDOW, BLOCK = 8, 128, 2048
PER_LANG, SLICE = 800, 200
STEPS, BATCH, TRAIN_T, RATE = 300, 192, 48, 0.02
PAD = 256
UNKNOWN = "und"
# for recognised(): every HELD-th sampled slice is held out; a text must score that share of the way from an even split to what nearly
# all held-out slices score
HELD, QUANTILE, STANDS_OUT = 5, 0.005, 0.15


def _sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Direction:
    """One gated recurrent layer: input tables ``x*`` (256 bytes x hidden), recurrences ``u*``."""

    NAMES = ("xz", "xr", "xc", "uz", "ur", "uc", "bc")

    def __init__(self, rng, hidden: int):
        def w(*shape):
            return rng.normal(0, 0.3 if shape[0] == 257 else 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.xz, self.xr, self.xc = w(257, hidden), w(257, hidden), w(257, hidden)
        self.xz[:256] += 1.0                    # remember by default
        self.uz, self.ur, self.uc = w(hidden, hidden), w(hidden, hidden), w(hidden, hidden)
        self.bc = np.zeros(hidden, dtype=np.float32)
        self.xz[PAD] = 40.0                     # padding keeps the state
        self.xr[PAD] = self.xc[PAD] = 0.0

    def forward(self, seq: np.ndarray, keep: bool = False):
        """``seq`` (T, B) -> states (T, B, H).  h' = z h + (1 - z) tanh(x + r (h U + b))."""
        t_max, b = seq.shape
        h = np.zeros((b, self.uz.shape[0]), dtype=self.uz.dtype)
        out = np.empty((t_max, *h.shape), dtype=h.dtype)
        saved = []
        for t in range(t_max):
            z = np.take(self.xz, seq[t], axis=0)
            z += h @ self.uz
            z *= 0.5
            np.tanh(z, out=z)
            z *= 0.5
            z += 0.5
            r = np.take(self.xr, seq[t], axis=0)
            r += h @ self.ur
            r *= 0.5
            np.tanh(r, out=r)
            r *= 0.5
            r += 0.5
            g = h @ self.uc
            g += self.bc
            c = np.take(self.xc, seq[t], axis=0)
            c += r * g
            np.tanh(c, out=c)
            if keep:
                saved.append((h, z, r, g, c))
            h = c + z * (h - c)
            out[t] = h
        return out, saved

    def backward(self, seq: np.ndarray, saved, dout: np.ndarray) -> dict[str, np.ndarray]:
        grad = {n: np.zeros_like(getattr(self, n)) for n in self.NAMES}
        dh = np.zeros_like(dout[0])
        for t in range(len(seq) - 1, -1, -1):
            h, z, r, g, c = saved[t]
            dh = dh + dout[t]
            dz = dh * (h - c) * z * (1 - z)
            dc = dh * (1 - z) * (1 - c * c)
            dr = dc * g * r * (1 - r)
            dg = dc * r
            for name, d in (("xz", dz), ("xr", dr), ("xc", dc)):
                np.add.at(grad[name], seq[t], d)
            grad["uz"] += h.T @ dz
            grad["ur"] += h.T @ dr
            grad["uc"] += h.T @ dg
            grad["bc"] += dg.sum(axis=0)
            dh = dh * z + dz @ self.uz.T + dr @ self.ur.T + dg @ self.uc.T
        for name in ("xz", "xr", "xc"):
            grad[name][PAD] = 0
        return grad


class BiGru:
    """Both directions and the output layer over their states."""

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 9):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.f, self.b = Direction(rng, hidden), Direction(rng, hidden)
        self.w = rng.normal(0, 0.3, (2 * hidden, len(langs))).astype(np.float32)
        self.bias = np.zeros(len(langs), dtype=np.float32)

    def params(self) -> list[np.ndarray]:
        return [getattr(d, n) for d in (self.f, self.b) for n in Direction.NAMES] + [self.w, self.bias]

    def probabilities(self, seq: np.ndarray) -> np.ndarray:
        """``seq`` (T, B) of bytes or PAD -> (T, B, languages)."""
        hf, _ = self.f.forward(seq)
        k = hf.shape[2]
        p = hf.reshape(-1, k) @ self.w[:k]
        del hf                                  # one direction's states at a time
        hb, _ = self.b.forward(seq[::-1])
        p += hb[::-1].reshape(-1, k) @ self.w[k:]
        p += self.bias
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=1, keepdims=True)
        return p.reshape(*seq.shape, -1)

    def loss_and_gradients(self, seq: np.ndarray, target: np.ndarray):
        """Mean cross entropy over the positions that aren't padding; ``target`` (B,)."""
        hf, sf = self.f.forward(seq, True)
        rev = seq[::-1]
        hb, sb = self.b.forward(rev, True)
        k = hf.shape[2]
        both = np.concatenate([hf, hb[::-1]], axis=2)
        logit = both @ self.w + self.bias
        logit -= logit.max(axis=2, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(axis=2, keepdims=True)
        real = (seq != PAD).astype(p.dtype)
        n = max(1.0, float(real.sum()))
        cols = np.arange(seq.shape[1])
        loss = -(np.log(p[:, cols, target] + 1e-12) * real).sum() / n
        p[:, cols, target] -= 1
        p *= real[:, :, None] / n
        d = p @ self.w.T
        gf, gb = self.f.backward(seq, sf, d[:, :, :k]), self.b.backward(rev, sb, d[::-1, :, k:])
        flat = p.reshape(-1, p.shape[2])
        grads = [g[n] for g in (gf, gb) for n in Direction.NAMES] + [both.reshape(-1, 2 * k).T @ flat, flat.sum(axis=0)]
        return loss, grads

    def fit(self, texts: list[bytes], target: np.ndarray, steps: int = STEPS, seed: int = 9):
        """Adam over random windows of ``TRAIN_T`` bytes."""
        rng = np.random.default_rng(seed)
        m = [np.zeros_like(p) for p in self.params()]
        v = [np.zeros_like(p) for p in self.params()]
        by_lang = [np.flatnonzero(target == k) for k in range(len(self.langs))]
        for step in range(1, steps + 1):
            rows = np.concatenate([rng.choice(x, -(-BATCH // len(by_lang))) for x in by_lang])
            seq = np.full((TRAIN_T, len(rows)), PAD, dtype=np.int64)
            for j, i in enumerate(rows):
                t = texts[i]
                at = int(rng.integers(0, max(1, len(t) - TRAIN_T + 1)))
                part = np.frombuffer(t[at:at + TRAIN_T], dtype=np.uint8)
                seq[:len(part), j] = part
            _, grads = self.loss_and_gradients(seq, target[rows])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, g, a, b in zip(self.params(), grads, m, v, strict=True):
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= (rate * (a / (1 - 0.9 ** step)) / (np.sqrt(b / (1 - 0.99 ** step)) + 1e-8)).astype(p.dtype)
        return self

    def label_positions(self, text: bytes) -> np.ndarray:
        """The language number of every byte of a text."""
        seq = _windows([text])[0]
        return self.probabilities(seq).argmax(axis=2).T.reshape(-1)[:len(text)]

    def pool(self, texts: list[bytes]) -> np.ndarray:
        """Mean probability over all positions of each text (texts x languages)."""
        seq, owner = _windows(texts)
        total = np.zeros((len(texts), len(self.langs)))
        for s in range(0, seq.shape[1], BLOCK):
            part = seq[:, s:s + BLOCK]
            longest = int((part != PAD).sum(axis=0).max(initial=0))
            p = self.probabilities(part[:longest])
            p *= (part[:longest] != PAD)[:, :, None]
            sums = p.sum(axis=0)
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(owner[s:s + BLOCK], sums[:, k], len(texts))
        return total / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def _windows(texts: list[bytes]):
    """All bytes of the texts in columns of WINDOW positions, and each column's text."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], dtype=np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    flat = np.full(int(counts.sum()) * WINDOW, PAD, dtype=np.int16)
    at = np.concatenate([[0], np.cumsum(counts) * WINDOW])
    for i, t in enumerate(texts):
        flat[at[i]:at[i] + len(t)] = np.frombuffer(t, dtype=np.uint8)
    return np.ascontiguousarray(flat.reshape(-1, WINDOW).T), owner


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(id_col.cast("string")), F.lit(3)) == 1, F.lit(False))


def slices(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``lang``, ``h``, ``part``: a slice of every document that may be learned from."""
    h = F.xxhash64(docs[id_col].cast("string"))
    text = text_or_empty(docs, text_col)
    start = F.pmod(h, F.greatest(F.char_length(text) - SLICE, F.lit(1)).cast("long")).cast("int") + 1
    return (docs.where(docs[id_col].isNotNull() & ~held_out(docs[id_col]) & docs[lang_col].isNotNull() & text.rlike(r"\p{L}"))
            .select(docs[lang_col].cast("string").alias("lang"), h.alias("h"), F.substring(text, start, F.lit(SLICE)).alias("part")))


def training_sample(docs: DataFrame, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text",
                    lang_col: str = "lang") -> list:
    """At most ``per_lang`` rows (``lang``, ``part``) a language."""
    rows = slices(docs, id_col, text_col, lang_col)
    r = F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))
    rows = rows.withColumn("r", r).where(F.col("r") <= per_lang).select("lang", "h", "part").collect()
    return sorted(rows, key=lambda x: (x.lang, x.h, x.part))


def train(sample: list) -> BiGru | None:
    langs = sorted({r.lang for r in sample})
    if not langs:
        return None
    target = np.array([langs.index(r.lang) for r in sample])
    # units and steps grow with the languages beyond four
    net = BiGru(langs, hidden=max(HIDDEN, 2 * len(langs)))
    return net.fit([r.part.encode("utf-8", "replace") for r in sample], target, steps=max(STEPS, STEPS * len(langs) // 4))


def level(net: BiGru, held: list, quantile: float = QUANTILE, share: float = STANDS_OUT) -> float:
    """The score below which no language stands out: an even split over the learned languages, raised by ``share`` of what a low
    quantile of the held-out slices scores above it."""
    even = 1 / len(net.langs)
    if not held:
        return even
    best = net.pool([r.part.encode("utf-8", "replace") for r in held]).max(axis=1)
    return even + share * max(0.0, float(np.quantile(best, quantile)) - even)


def level_of_all(net: BiGru, sample: list, held: list, rows: DataFrame) -> float:
    """``level`` over the slices of all documents (``rows``) that were not learned from: the held-out ones of the sample and every one beyond it.  The quantile is
    taken by Spark over all of them, to a rank of 1 in 100,000; where the sample is the whole table, it is ``level``."""
    last: dict[str, tuple] = {}
    for r in sample:
        last[r.lang] = max(last.get(r.lang, (r.h, r.part)), (r.h, r.part))
    end = F.create_map(*[F.lit(x) for k, v in last.items() for x in (k, v[0])])[F.col("lang")]
    part = F.create_map(*[F.lit(x) for k, v in last.items() for x in (k, v[1])])[F.col("lang")]
    beyond = rows.where((F.col("h") > end) | ((F.col("h") == end) & (F.col("part") > part))).select("part")
    if held:
        beyond = beyond.withColumn("more", F.lit(True)).unionByName(
            rows.sparkSession.createDataFrame([(r.part, False) for r in held], "part string, more boolean"))
    else:
        beyond = beyond.withColumn("more", F.lit(True))
    score = predictor(net)("part")["score"]
    more, low = beyond.select("more", score.alias("score")).agg(F.count_if("more"), F.percentile_approx("score", QUANTILE, 100_000)).first()
    even = 1 / len(net.langs)
    return even + STANDS_OUT * max(0.0, low - even) if more else level(net, held)


def predictor(net: BiGru | None):
    """Text column (no nulls) -> struct ``lang_pred``, ``score``."""
    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import regex
        letter, langs = regex.compile(r"\p{L}"), np.array(net.langs if net else [], dtype=object)
        for texts in batches:
            lang, score = np.full(len(texts), UNKNOWN, dtype=object), np.zeros(len(texts))
            first: dict[str, int] = {}
            at = np.array([i for i, t in enumerate(texts) if net and letter.search(t)], dtype=np.int64)
            values = texts.to_numpy()
            which = np.array([first.setdefault(values[i], len(first)) for i in at], dtype=np.int64)      # copies once
            distinct = [t.encode("utf-8", "replace") for t in first]
            pooled, i = np.zeros((len(distinct), len(langs))), 0
            while i < len(distinct):            # some 2 MB of text at a time
                j, size = i, 0
                while j < len(distinct) and (j == i or size + len(distinct[j]) < 2 << 20):
                    size += len(distinct[j])
                    j += 1
                pooled[i:j] = net.pool(distinct[i:j])
                i = j
            if len(at):
                p = pooled[which]
                best = p.argmax(axis=1)
                lang[at], score[at] = langs[best], np.clip(p[np.arange(len(at)), best], 0, 1)
            yield pd.DataFrame({"lang_pred": lang, "score": score})
    return predict


def identify(docs: DataFrame, per_lang: int = PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``id``, ``held_out``, ``lang_pred``, ``score`` per row; see the module."""
    predict = predictor(train(training_sample(docs, per_lang, id_col, text_col, lang_col)))
    rows = docs.select(docs[id_col].alias("id"), held_out(docs[id_col]).alias("held_out"), predict(text_or_empty(docs, text_col)).alias("p"))
    return rows.select("id", "held_out", "p.lang_pred", "p.score")


def recognised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that have a letter and in which some learned language stands out: the score reaches ``level``, set from slices of all
    labelled documents that the network has not learned from, relative to the number of languages.  Mixed but clean texts stay; texts that the network finds as much like one language as another go.
    A text in an unlearned language may still look like a learned one, and stays then.  Other columns don't pass through Python.  With nothing to learn from,
    or one language only, every row that has a letter stays."""
    sample = training_sample(docs, id_col=id_col, text_col=text_col, lang_col=lang_col)
    held = sample[HELD - 1::HELD]
    net = train([r for i, r in enumerate(sample) if i % HELD != HELD - 1])
    text = text_or_empty(docs, text_col)
    if net is None or len(net.langs) == 1:
        return docs.where(text.rlike(r"\p{L}"))
    (name,) = fresh(docs, "p")
    least = level_of_all(net, sample, held, slices(docs, id_col, text_col, lang_col))
    out = docs.withColumn(name, predictor(net)(text))
    return out.where((F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.score") >= least)).select(*[docs[c] for c in docs.columns])
