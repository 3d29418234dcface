"""M operators against plain-Python versions written from the published
definitions (corpus BLEU, ROUGE-N/L)."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from kgflow.functions import score as M


def _tok13a(s):
    s = s.replace("<skipped>", "").replace("-\n", "").replace("\n", " ")
    s = s.replace("&quot;", '"').replace("&amp;", "&").replace("&lt;", "<").replace("&gt;", ">")
    s = f" {s} "
    s = re.sub(r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 ", s)
    s = re.sub(r"([^0-9])([\.,])", r"\1 \2 ", s)
    s = re.sub(r"([\.,])([^0-9])", r" \1 \2", s)
    s = re.sub(r"([0-9])(-)", r"\1 \2 ", s)
    return s.split()


def _ngr(t, n):
    return Counter(tuple(t[i:i + n]) for i in range(len(t) - n + 1))


def _bleu(preds, refs, order=4):
    m = [0] * order
    poss = [0] * order
    tl = rl = 0
    for p, rs in zip(preds, refs):
        pt, rts = _tok13a(p), [_tok13a(r) for r in rs]
        tl += len(pt)
        rl += min(len(r) for r in rts)
        for n in range(1, order + 1):
            merged = Counter()
            for r in rts:
                merged |= _ngr(r, n)
            m[n - 1] += sum((_ngr(pt, n) & merged).values())
            poss[n - 1] += max(len(pt) - n + 1, 0)
    prec = [m[i] / poss[i] if poss[i] else 0.0 for i in range(order)]
    geo = math.exp(sum(math.log(p) for p in prec) / order) if min(prec) > 0 else 0.0
    ratio = tl / rl
    bp = 1.0 if ratio > 1.0 else math.exp(1 - 1 / ratio)
    return geo * bp


def test_bleu_multi_reference(spark):
    rnd = random.Random(3)
    words = ["( AND", "[ Document ]", "JOIN", "x.", "3-4", "a,b", "&amp;", "issues", ")"]
    rows = []
    for i in range(300):
        p = " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 12)))
        rs = [" ".join(rnd.choice(words) for _ in range(rnd.randint(3, 12))) for _ in range(rnd.randint(1, 3))]
        rows.append((i, p, rs))
    df = spark.createDataFrame(rows, "id long, pred string, refs array<string>")
    got = M.bleu(df).first().bleu
    assert abs(got - _bleu([r[1] for r in rows], [r[2] for r in rows])) < 1e-12


def test_tok13a(spark):
    s = 'He said "3.5-4" &amp; left, then.'
    df = spark.createDataFrame([(s,)], "s string")
    assert list(df.select(M.tok13a("s").alias("t")).first().t) == _tok13a(s)


def _rouge_tok(s):
    return [t for t in re.sub(r"[^a-z0-9]+", " ", s.lower()).split() if t]


def _lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(t[i - 1][j], t[i][j - 1])
    return t[-1][-1]


def _f(p, r):
    return 0.0 if p + r == 0 else 2 * p * r / (p + r)


def test_rouge_n_and_l(spark):
    rows = [(1, "the cat sat on the mat", ["the cat is on the mat", "a dog"]), (2, "É x y", ["x y z"]),
            (3, "", ["nothing"])]
    df = spark.createDataFrame(rows, "id long, pred string, refs array<string>")
    per = {r.id: r for r in M.rouge_n(df).collect()}
    lper = {r.id: r for r in M.rouge_l(df, keep=["id"]).collect()}
    for i, p, rs in rows:
        pt = _rouge_tok(p)
        for n in (1, 2):
            best = 0.0
            for r in rs:
                rt = _rouge_tok(r)
                ov = sum((_ngr(pt, n) & _ngr(rt, n)).values())
                best = max(best, _f(ov / max(len(pt) - n + 1, 1), ov / max(len(rt) - n + 1, 1)))
            assert abs(getattr(per[i], f"rouge{n}") - best) < 1e-12
        bl = max(_f(_lcs(pt, _rouge_tok(r)) / len(pt) if pt else 0, _lcs(pt, _rouge_tok(r)) / len(_rouge_tok(r))
                    if _rouge_tok(r) else 0) for r in rs)
        assert abs(lper[i].rougeL - bl) < 1e-12


def test_exact_match_empty_is_null_and_missing_is_miss(spark):
    empty = spark.createDataFrame([], "pred string, golds array<string>")
    assert M.exact_match(empty).first().accuracy is None
    df = spark.createDataFrame([("a", ["a"]), (None, ["b"])], "pred string, golds array<string>")
    assert M.exact_match(df).first().accuracy == 0.5


def test_label_helpers(spark):
    df = spark.createDataFrame([([5, -100, 0, 7],)], "ids array<int>")
    r = df.select(M.unmask_labels("ids", 0).alias("u"), M.gen_len("ids", 0).alias("n")).first()
    assert list(r.u) == [5, 0, 0, 7] and r.n == 3


def test_attach_gold_missing_prediction_is_a_miss(spark):
    gold = spark.createDataFrame([(0, ["a"]), (1, ["b"]), (2, ["c"])], "idx long, golds array<string>")
    pred = spark.createDataFrame([(0, "a"), (2, "x")], "idx long, pred string")
    assert M.exact_match(M.attach_gold(gold, pred)).first().accuracy == 1 / 3


def test_lcs_bits_against_table():
    import random
    from kgflow.functions.score import _lcs, _lcs_positions
    rnd = random.Random(5)
    for _ in range(300):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randrange(9))] for _ in range(2))
        best = 0
        for bits in range(1 << len(a)):
            sub = [x for i, x in enumerate(a) if bits >> i & 1]
            it = iter(b)
            if all(x in it for x in sub):
                best = max(best, len(sub))
        at = _lcs_positions(a, b)
        it = iter(b)
        assert _lcs(a, b) == best == len(at) and at == sorted(set(at)) and all(a[i] in it for i in at)


def test_lcs_of_long_texts():
    from kgflow.functions.score import _lcs, _lcs_positions
    a, b = [str(i % 911) for i in range(12000)], [str(i % 877) for i in range(12000)]
    assert _lcs(a, a) == 12000 and len(_lcs_positions(a, b)) == _lcs(a, b)


def test_retrieval_report(spark):
    from kgflow.functions import score as M
    df = spark.createDataFrame([(1, "a b c d e", ["a b c d e"]), (2, "a b", ["a c", "b"]), (3, None, ["x"])], "id long, pred string, golds array<string>")
    r = M.score_retrieval(df).first()
    one = M.bleu(df, "pred", "golds", "id", detail=True).first()
    per = M.rouge_summary(M.rouge_scores(df, "pred", "golds"), ["rouge1", "rougeL"]).first()
    assert round(r.accuracy, 6) == round(1 / 3, 6) and r.bleu == one.bleu and r.translation_length == one.translation_length
    assert (r.rouge1, r.rougeL) == (per.rouge1, per.rougeL)


def test_ngram_counts_on_edge_rows(spark):
    """Null and empty sides, null references, repeated n-grams, no reference, any order; \x1c splits as white space."""
    rows = [(1, None, ["a b"]), (2, "a a a a b", ["a a b b", "a a a", None]), (3, "a b", None), (4, "a b", []), (5, "", [""]),
            (6, "a\x1cb a\x1cb c", ["a b c", "a b a b"]), (7, "x " * 3000, ["x " * 2000 + "y", "x"])]
    assert M.bleu_parts(spark.createDataFrame([], "id long, pred string, refs array<string>")).count() == 0
    df = spark.createDataFrame(rows, "id long, pred string, refs array<string>")
    parts = {r.id: r for r in M.bleu_parts(df).collect()}
    rouge = {r.id: r for r in M.rouge_n(df, orders=(1, 3)).collect()}
    for i, p, rs in rows:
        pt, rts = _tok13a(p or ""), [_tok13a(r or "") for r in rs or []]
        for n in range(1, 5):
            merged = Counter()
            for r in rts:
                merged |= _ngr(r, n)
            assert parts[i][f"m{n}"] == sum((_ngr(pt, n) & merged).values()), (i, n)
            assert parts[i][f"poss{n}"] == max(len(pt) - n + 1, 0)
        assert (parts[i].tl, parts[i].rl) == (len(pt), min(map(len, rts), default=0))
        pt, rts = _rouge_tok(p or ""), [_rouge_tok(r or "") for r in rs or []]
        for n in (1, 3):
            best = 0.0
            for r in rts:
                hits = sum((_ngr(pt, n) & _ngr(r, n)).values())
                best = max(best, _f(hits / max(len(pt) - n + 1, 1), hits / max(len(r) - n + 1, 1)))
            assert abs(rouge[i][f"rouge{n}"] - best) < 1e-12, (i, n)


def test_ngram_counts_do_not_depend_on_slices(monkeypatch):
    import numpy as np
    import pyarrow as pa
    rnd = random.Random(8)
    t = pa.array([[rnd.choice("abc") for _ in range(rnd.randrange(9))] for _ in range(50)], pa.list_(pa.string()))
    r = pa.array([[[rnd.choice("abc") for _ in range(rnd.randrange(9))] for _ in range(rnd.randrange(3))] for _ in range(50)],
                 pa.list_(pa.list_(pa.string())))
    whole = [c for _, _, c in M._overlaps(t, r, 4)]
    for size in (1, 17, 100):
        monkeypatch.setattr(M, "SLICE_TOKENS", size)
        parts = [[c for _, _, c in M._overlaps(a, b, 4)] for a, b in M._slices(t, r)]
        assert all((np.concatenate(x) == w).all() for x, w in zip(zip(*parts), whole))
    assert len(parts) > 3
