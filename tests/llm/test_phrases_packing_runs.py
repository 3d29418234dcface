"""Phrase collocations, packing and periodic runs against brute force, on odd rows, on an empty table and on the small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm_rows import SF001, none, odd, odd_rows  # noqa: F401

from kgflow.llm import collocations, packing, runs
from kgflow.llm.queries import op11_collocations, op12_packing, op13_periodic_runs, planted

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


# ---- 11
def brute_phrases(rows, k=3, min_count=10, cover=50, top=2000):
    count, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        g = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(collocations.FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[g] += len(w)
            for j in range(1, k + 1):
                count[g].update(tuple(w[i:i + j]) for i in range(len(w) - j + 1))
    out = []
    for g, f in count.items():
        cand = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        gone = {p[i:i + j] for p, a in cand.items() for j in range(2, len(p)) for i in range(len(p) - j + 1) if 100 * a >= cover * f[p[i:i + j]]}
        rank = []
        for p, a in cand.items():
            if p not in gone:
                s, _, left, right = min((1000000 * a * a // (f[p[:j]] * f[p[j:]]), j, f[p[:j]], f[p[j:]]) for j in range(1, len(p)))
                rank.append((-s, -a, " ".join(p).encode(), left, right))
        out += [(g, i + 1, p.decode(), -a, left, right, n[g], -s) for i, (s, a, p, left, right) in enumerate(sorted(rank)[:top])]
    return sorted(out)


def phrases(df, **kw):
    return sorted(tuple(r) for r in collocations.collocations(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def phrase_rows():
    rng = random.Random(4)
    words = ["Aa", "b", "c", "dé", "E", "f", "g", "h", "i", "j", "k", "ÀX", "m", "n"]
    base = [" ".join(rng.choice(words) + str(i) for i in range(60)) for _ in range(3)]
    rows = []
    for i in range(1500):
        t = "".join(rng.choice(words[:6]) + rng.choice([" ", " ", "  ", "\t", ". ", ",", " \n", "\x0b"]) for _ in range(rng.randrange(30)))
        t += " " + rng.choice(base) + rng.choice(["", " z", " y x"]) if i % 20 == 0 else ""
        rows.append((t + (" a b a b a b a b" if i % 30 == 0 else ""), rng.choice(["en", "en", None, "und", "de"])))
    return rows + [(None, "en"), ("", "xx"), (None, None)]


@pytest.mark.parametrize("kw", [{}, {"max_words": 2, "top": 7}, {"max_words": 4, "min_count": 3, "cover": 80}])
def test_phrases(spark, phrase_rows, kw):
    df = spark.createDataFrame(phrase_rows, "text string, lang string").repartition(3)
    names = {"max_words": "k"}
    assert phrases(df, **kw) == brute_phrases(phrase_rows, **{names.get(a, a): b for a, b in kw.items()})


def test_phrases_small_chunks(phrase_rows, monkeypatch):
    rows = [(collocations._hash(lang or "und"), t or "") for t, lang in phrase_rows]

    def summed(k, limit):
        total, chunk = Counter(), collocations.Chunk(k, collocations.Names())
        for lang, t in rows:
            for s in collocations._slices(t):
                chunk.feed(s, lang)
                if chunk.words > limit:
                    out = chunk.sums()
                    total.update(dict(zip(zip(*[out[n].tolist() for n in out if n != "c"], strict=True), out["c"].tolist(), strict=True)))
                    chunk = collocations.Chunk(k, collocations.Names() if len(chunk.names.words) > 30 else chunk.names)
        out = chunk.sums()
        total.update(dict(zip(zip(*[out[n].tolist() for n in out if n != "c"], strict=True), out["c"].tolist(), strict=True)))
        return total

    for k in (1, 2, 3, 7):
        whole = summed(k, 1 << 30)
        with monkeypatch.context() as m:
            m.setattr(collocations, "SLICE", 40)
            assert summed(k, 100) == whole
        assert sum(whole.values()) == sum(len(re.findall(r"[^ \t.,;:!?\n-\r]+", t)) for _, t in rows)


def test_phrases_long_path_is_compacted(spark):
    # 12 copies of one passage are one path, cut into segments; its inner nodes are no candidates
    text = " ".join(f"w{i}" for i in range(500))
    df = spark.createDataFrame([(text + f" x{i}", "en") for i in range(12)], "text string, lang string")
    edge = collocations.edges(df.selectExpr("xxhash64(lang) as lang", "text as t"), 3)
    grams = collocations.flows(edge, 3, 10).where("f >= 10")
    e, n = collocations._gram(grams, 3, 3), collocations._gram(grams, 3, 2)
    paths = collocations.unary_paths(e, n, ["u0", "u1", "u2"])
    assert paths.count() == 497 and paths.select("root").distinct().count() == 1
    got = collocations.compacted(e, paths, ["u0", "u1", "u2"], segment=200).collect()
    assert sorted(len(r.words) for r in got) == [100, 202, 202] and {r.f for r in got} == {12}
    assert phrases(df) == brute_phrases([(text + f" x{i}", "en") for i in range(12)])


def test_phrases_odd_and_small(spark, odd, small, none):
    for df in (odd, small):
        assert phrases(df) == brute_phrases([(r.text, r.lang) for r in df.select("text", "lang").collect()])
    assert phrases(none) == []
    assert op11_collocations(spark, SF001).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


# ---- 12
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(packing.tokenizer_path())


def check_packed(rows, out, size=2048):
    """Every id in exactly one piece, windows gapless and within size; returns (used, padding)."""
    t = library()
    want = Counter()
    ids_of = defaultdict(list)
    for d, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        want[d, len(ids)] += len(ids)
        ids_of[d, len(ids)].append(ids)
    got = Counter()
    windows = defaultdict(list)
    for r in out:
        got[r.id, r.doc_tokens] += r.length
        assert any(zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for x in ids_of[r.id, r.doc_tokens])
        windows[r.sequence_id].append((r.offset, r.length))
    assert got == want
    starts = defaultdict(Counter)
    for r in out:
        starts[r.id, r.doc_tokens][r.start] += 1
        starts[r.id, r.doc_tokens][r.start + r.length] -= 1
    for key, s in starts.items():                    # pieces of one document follow each other
        assert {p: c for p, c in s.items() if c} == {0: len(ids_of[key]), key[1]: -len(ids_of[key])}
    used = padding = 0
    for w in windows.values():
        at = 0
        for o, n in sorted(w):
            assert o == at and n > 0
            at += n
        assert at <= size
        used, padding = used + at, padding + (0 if at & (at - 1) == 0 else size - at)
    return used, padding


def test_packing(odd, small, none):
    for df, kw in ((odd, {}), (small, {}), (odd.repartition(40), {"window": 256, "open_windows": 4, "merge": 16}), (none, {})):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        used, padding = check_packed(rows, packing.pack(df, **kw).collect(), kw.get("window", 2048))
        assert padding == 0 and (used or not rows)


def test_packing_ids_and_refusals(odd, spark):
    out = packing.pack(odd, with_ids=True).collect()
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32 for r in out)
    with pytest.raises(ValueError):
        packing.pack(odd, path=packing.tokenizer_path("byte_bpe_50k.json"))
    with pytest.raises(ValueError):
        packing.pack(odd, window=1000)
    assert op12_packing(spark, SF001).columns[0] == "doc_id"


def test_open_windows_best_fit():
    w = packing.OpenWindows(size=10, limit=2)
    ids = np.arange(100)
    assert w.add("a", 0, ids[:6]) == [] and w.add("b", 0, ids[:7]) == []
    out = w.add("c", 0, ids[:3])                     # exactly fills b's window
    assert [[d for d, *_ in x] for x in out] == [["b", "c"]]
    assert w.add("d", 0, ids[:8]) == []              # a new window, since a's has only 4 left
    out = w.add("e", 0, ids[:5])                     # fits nowhere: the fullest (d, 2 left) is topped up, then a's (4 left) holds the rest
    assert [[(d, s, len(i)) for d, s, i in x] for x in out] == [[("d", 0, 8), ("e", 0, 2)]]
    assert [[(d, s, len(i)) for d, s, i in x] for x in w.rest()] == [[("a", 0, 6), ("e", 2, 3)]]
    assert [sum(len(i) for *_, i in x) for x in packing.pour([[("x", 0, ids[:9])], [("y", 0, ids[:8])], [("z", 0, ids[:8])]], 8)] == [8, 8, 8, 1]


def test_word_ids_against_library():
    rng = random.Random(3)
    signs = ["don't", "we'LL", "'s", "'", " ", "  ", "\n", "a", "É", "ß", "œ", "Œ", "x1y2", "3.5", "...", "—", "\xa0", "\x1c", "\x85", "é", "İ", "Σας", "漢字", "<|endoftext|>", "<|", "|>",
             "ª", "²", "½", "_", "I'M", "'RE", " ", "µ", "Ÿ", "\x00", "\xad"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(4000)] + ["", "x" * 200_000]
    t = library()
    for text, ids in zip(texts, packing.documents_ids(texts, packing.WordIds(packing.tokenizer_path())), strict=True):
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_long_texts_in_slices(monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 64)
    t, texts = library(), ["ab cd, " * 100, "x" * 500, "", "one two" * 30 + "\n" + "three " * 40]
    for text, ids in zip(texts, packing.documents_ids(texts, packing.WordIds(packing.tokenizer_path())), strict=True):
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


# ---- 13
def brute_runs(w, min_length=24, exponent=3):
    n, out = len(w), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(min_length, exponent * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted((a, z - a, q) for (a, z), q in out.items())


def brute_collapsed(w, found):
    gone = set()
    for a, n, q in found:
        gone.update(range(a + q, a + n))
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_find_runs():
    rng = random.Random(1)
    total = 0
    for _ in range(600):
        docs = []
        for _ in range(rng.randrange(1, 4)):
            n, letters = rng.randrange(260), rng.choice([1, 2, 2, 3, 50])
            w = [rng.randrange(letters) for _ in range(n)]
            for _ in range(rng.randrange(3) if n > 30 else 0):
                a = rng.randrange(n)
                p = 1 + rng.randrange(max(1, (n - a) // 3))
                for i in range(a, rng.randrange(a, n + 1)):
                    w[i] = w[a + (i - a) % p]
            docs.append(w)
        got = runs.find_runs([np.array(w, dtype=np.int64) for w in docs])
        want = [brute_runs(w) for w in docs]
        assert got == want
        total += sum(map(len, want))
    assert total > 100


def test_long_periods_and_streams(monkeypatch):
    rng = np.random.default_rng(0)
    docs = [np.tile(rng.integers(0, 900, q), 4)[:int(3.3 * q)] for q in (9, 33, 64, 700, 1000)] + [np.zeros(5000, dtype=np.int64), np.arange(4000) % 7, rng.integers(0, 9, 3000)]
    want = runs.find_runs(docs)
    assert [w[0][2] for w in want[:7]] == [9, 33, 64, 700, 1000, 1, 7] and all(w[0][0] == 0 and w[0][1] == len(d) for w, d in zip(want[:7], docs))
    monkeypatch.setattr(runs, "STREAM", 100)         # every document its own stream
    assert runs.find_runs(docs) == want


def test_periodic_runs(spark, odd, small, none):
    for df in (odd, small, none):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        rows = [r for r in rows if len(r[1] or "") < 20_000]
        want = Counter()
        for d, t in rows:
            w = WORD.findall(t or "")
            found = brute_runs(w)
            want[d, len(w), tuple(found), brute_collapsed(w, found)] += 1
        short = df.where("coalesce(length(text), 0) < 20000")
        got = Counter((r.id, r.n_words, tuple((x.start, x.length, x.period) for x in r.runs), r.collapsed) for r in runs.periodic_runs(short).collect())
        assert got == want
    long = {r.id: r.runs for r in runs.periodic_runs(odd.where("doc_id in (402, 403)")).collect()}
    assert [tuple(x) for x in long[402]] == [(0, 30_000, 1)] and [tuple(x) for x in long[403]] == [(0, 5000, 1)] or [x.period for x in long[403]] == [1]


def test_op13_digest(spark, small):
    docs = [(r.doc_id, r.text) for r in small.select("doc_id", "text").collect()]
    want, some = Counter(), 0
    for d, t in docs:
        w = WORD.findall(t or "")
        h = zlib.crc32(str(d).encode())
        g = h // 10
        if h % 10 == 0 and w:
            a, n = g % len(w), len(w)
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        found = brute_runs(w) if len(w) < 3000 else [tuple(x) for x in runs.find_runs([np.unique(w, return_inverse=True)[1]])[0]]
        some += len(found)
        best = None
        for a, n, q in found:
            if best is None or n * best[2] > best[1] * q:
                best = (a, n, q)
        lines = "".join(f"{a},{n},{q}\n" for a, n, q in found)
        want[(d, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256(lines.encode()).hexdigest(),
              hashlib.sha256(brute_collapsed(w, found).encode()).hexdigest())] += 1
    assert Counter(map(tuple, op13_periodic_runs(spark, SF001).collect())) == want and some


def test_planted_null_and_empty():
    assert planted(None, 5) is None and planted("1", 0) is None
