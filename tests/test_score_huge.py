"""Texts too long for one row's work: the same scores from ranges of tokens, and a small traceback."""

import random
import tracemalloc

import pytest
from pyspark.sql import functions as F

from kgflow.functions import score as M


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["a", "b,", "c.", "d-e", "3.5", "F", "gg", "\n", "&amp;"])
    text = lambda n: " ".join(word() for _ in range(n))
    data = [(i, text(rng.choice([0, 1, 3, 40, 300])), [text(rng.choice([0, 2, 50, 250])) for _ in range(rng.randrange(4))]) for i in range(60)]
    data += [(100, None, ["a b"]), (101, "a b", None), (102, "a b", [None, "a"]), (103, text(400), [text(400)] * 2), (103, text(400), [text(3)])]
    return spark.createDataFrame([(i, "x" if i % 2 else "y", p, r) for i, p, r in data], "id int, run string, pred string, refs array<string>").repartition(3)


@pytest.mark.parametrize("huge,piece", [(0, 7), (200, 16), (1 << 40, 16)])
def test_ranges_give_the_same_counts(rows, huge, piece):
    def parts(**kw):
        return sorted(tuple(r) for r in M.bleu_parts(rows, "pred", "refs", "id", by=["run"], **kw).collect())

    def rouge(**kw):
        return sorted(tuple(round(x, 12) if isinstance(x, float) else x for x in r) for r in M.rouge_n(rows, "pred", "refs", "id", orders=(1, 2, 3), **kw).collect())
    assert parts(huge_chars=huge, piece=piece) == parts()
    assert rouge(huge_chars=huge, piece=piece) == rouge()
    assert M.bleu(rows, huge_chars=huge, piece=piece, detail=True).collect() == M.bleu(rows, detail=True).collect()


def test_one_huge_text_is_many_tasks_work(spark):
    text = spark.range(200_000).select(F.concat(F.lit("w"), (F.col("id") * 7919) % 997).alias("w")).agg(F.array_join(F.collect_list("w"), " ").alias("t"))
    df = text.select(F.lit(1).alias("id"), F.col("t").alias("pred"), F.array("t").alias("refs"))
    tokens = df.select(F.lit(0).cast("long").alias("_row"), F.split("pred", " ").alias("_p"))
    dealt = M._gram_rows(tokens, ["_row"], "_p", 2, 1000)
    assert "REPARTITION_BY_COL" in dealt._jdf.queryExecution().executedPlan().toString()
    assert dealt.agg(F.sum("c")).first()[0] == 200_000 + 199_999
    assert abs(M.bleu(df, huge_chars=1000, piece=1000).first().bleu - 1.0) < 1e-12


def _table_way(a, b):
    n, m = len(a), len(b)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            t[i + 1][j + 1] = t[i][j] + 1 if a[i] == b[j] else max(t[i][j + 1], t[i + 1][j])
    out, i, j = [], n, m
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.append(i - 1)
            i, j = i - 1, j - 1
        elif t[i - 1][j] == t[i][j]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def test_traceback_without_the_table():
    rng = random.Random(0)
    for _ in range(1500):
        k = rng.choice([2, 4, 20])
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(40))] for _ in range(2))
        want = _table_way(a, b)
        assert M._lcs_positions(a, b) == want and M._lcs(a, b) == len(want)


def test_traceback_memory():
    """100,000 tokens against 100,000: the table would hold 1.25 GB."""
    rng = random.Random(1)
    a, b = ([str(rng.randrange(3000)) for _ in range(100_000)] for _ in range(2))
    tracemalloc.start()
    places = M._lcs_positions(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6 and len(places) == M._lcs(a, b)


def test_only_n_grams_that_may_match_are_dealt(spark):
    """Tokens that the other side has not are no n-grams, and the others are numbers."""
    rows = spark.createDataFrame([(1, ["a", "x", "b", "c"], [["b", "c", "y"], ["a"]]), (2, [], [["a"]]), (3, ["q"] * 5, [])],
                                 "_row long, _p array<string>, _r array<array<string>>")
    coded = {r._row: (r._p, r._r) for r in M._coded(rows).collect()}
    assert coded == {1: ([0, -1, 1, 2], [[1, 2, -1], [0]]), 2: ([], [[-1]]), 3: ([-1] * 5, [])}
    grams = M._gram_rows(M._coded(rows).select("_row", "_p"), ["_row"], "_p", 2, 2)
    assert sorted((r._row, r.n, r.gram, r.c) for r in grams.collect()) == [(1, 1, "0", 1), (1, 1, "1", 1), (1, 1, "2", 1), (1, 2, "1 2", 1)]


def test_a_batch_is_counted_in_little_memory():
    """10,000 rows of 80 tokens with one reference each: the counts of a slice bound the memory, not the batch."""
    import numpy as np
    import pyarrow as pa
    words = np.array([f"word{i}" for i in range(5000)], dtype=object)[np.random.default_rng(1).integers(0, 5000, 800_000)]
    tokens = pa.ListArray.from_arrays(pa.array(np.arange(10_001) * 80, pa.int32()), pa.array(words))
    refs = pa.ListArray.from_arrays(pa.array(np.arange(10_001), pa.int32()), tokens)
    tracemalloc.start()
    for t, r in M._slices(tokens, refs):
        list(M._overlaps(t, r, 2))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(peak)
    assert peak < 50e6
