"""Rows that the operator tests share."""

import random

import pytest

WORDS = "the of and river stone house green light seven market window garden paper winter silver letter morning bridge".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """doc_id, text, lang, source, n_chars plus clashing names: nulls, blanks, long texts, copies,
    near copies, repeated rows and ids."""
    rng = random.Random(5)
    base = [sentence(rng, 40) for _ in range(30)]
    line = "This very line is shared by many documents"
    rows = [(i, t, "en" if i % 2 else "de", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[0], "en", "s0", None) for i in range(40)]                                # copies
    rows += [(200 + i, base[1] + f"\n{line}\n  {line.upper()} \nend{i}", "en", None, 3) for i in range(8)]
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \t\n ", "en", "s1", 4), (303, "%%% 123", "en", "", 7)]
    rows += [(None, base[2], "en", "s2", 1), (None, base[2], "en", "s2", 1), (None, line + "\nx", "en", "s2", 1), (None, None, None, None, None)]
    rows += [(7, base[7], "en", "s1", 5), (7, base[7], "en", "s1", 5), (8, base[9], "en", "s1", 5)]  # repeated row and id
    rows += [(400, sentence(rng, 9000), "en", "s1", 1), (401, "x" * 70_000, "en", "s2", 1), (402, ("ab\n" * 30_000), "en", "s2", 1),
             (403, "é<|endoftext|>ñ " * 5000, "es", "s2", 1)]
    return rows


SF001 = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("id", "t", "k1", "k2", "fp", "h", "size", "shard", "slot", "p", "_id", "_h1", "_src", "_n", "cell", "b", "root", "line", "pos")


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(odd_rows, SCHEMA)
    return df.select("*", *[F.lit(f"clash-{c}").alias(c) for c in CLASH]).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
