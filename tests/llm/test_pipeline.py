"""The pipeline's stages on their own inputs."""

import random
import re
from collections import Counter

import corpus_pipeline
from llm_rows import SF001, none, odd, odd_rows  # noqa: F401
from pyspark.sql import functions as F

from kgflow.llm import langid, simhash
from kgflow.llm.common import BATCH_KEY, read, staged


def rows(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages(spark):
    docs = read(spark, SF001, "documents")
    steps, seen = dict(corpus_pipeline.STAGES), [docs]
    assert list(steps) == ["language", "near_dedup", "decontaminate", "mix", "shard"]
    for name in list(steps)[:-1]:
        seen.append(steps[name](spark, seen[-1], SF001))
        assert seen[-1].columns == docs.columns
    lang, near, clean, mixed = map(rows, seen[1:])
    assert {d for d, t in rows(docs) - lang} == {d for d, t in rows(docs) if not re.search(r"[^\W\d_]", t or "")}
    assert not near - lang and max(Counter(t for _, t in near).values()) == 1
    items = [" ".join(r.text.split()) for r in read(spark, SF001, "benchmark").collect()]
    gone = {d for d, t in near if any(i in " ".join(t.split()) for i in items)}
    assert gone <= {d for d, _ in near - clean} and len(near - clean) <= len(gone) + 2
    assert set(mixed) <= set(clean) and max(mixed.values()) <= 3


def test_run(spark):
    out = corpus_pipeline.run(spark, SF001).collect()
    assert out and {r.shard for r in out} <= set(range(24))
    slots = Counter((r.shard, r.slot) for r in out)
    assert max(slots.values()) == 1


def brute_one_of_each(marks):
    """All pairs of fingerprints -> the (id, fp) that stays of every component: the smallest id, null last."""
    fps = sorted({m.fp for m in marks})
    up = {f: f for f in fps}

    def root(f):
        while up[f] != f:
            f = up[f]
        return f
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= simhash.RADIUS:
                up[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for m in marks:
        groups.setdefault(root(m.fp), []).append(m)
    return Counter(min(g, key=lambda m: (m.id is None, m.id or 0)).id for g in groups.values())


def test_near_dedup_against_all_pairs(spark, odd):
    for df in (odd, read(spark, SF001, "documents")):
        want = brute_one_of_each(simhash.near_duplicates(df).collect())
        kept = simhash.one_of_each(df)
        assert Counter(r.doc_id for r in kept.collect()) == want and kept.columns == df.columns
        assert not rows(kept) - rows(df)


def test_near_dedup_moves_few_texts(spark):
    plan = simhash.one_of_each(read(spark, SF001, "documents"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan


def test_stages_on_odd_rows_and_clashing_names(spark, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF001)
        if name != "shard":
            assert out.columns == odd.columns, name
            docs = staged(out, f"test-{name}")
    got = out.collect()
    assert got and Counter((r.shard, r.slot) for r in got).most_common(1)[0][1] == 1
    assert {r.doc_id for r in got} <= {r.doc_id for r in odd.collect()}


def test_stages_on_an_empty_table(spark, none):
    docs = none
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF001)
        assert out.count() == 0, name
        docs = out if name != "shard" else docs


def test_language_level_follows_the_languages(spark):
    """Even splits go, clean and mixed texts stay, whatever the number of learned languages."""
    rng = random.Random(7)
    words = {"aa": "kata mono tero lina".split(), "bb": "schrif wald brunn kraft".split(), "cc": "xyzzy quuxq plugh zorkm".split()}
    for langs in (["aa"], ["aa", "bb"], ["aa", "bb", "cc"]):
        data = [(i * 10 + j, " ".join(rng.choice(words[g]) for _ in range(40)), g) for j, g in enumerate(langs) for i in range(60)]
        data += [(9001, "", langs[0]), (9002, None, langs[0]), (9003, "12 34 ...", langs[0])]
        df = spark.createDataFrame(data, "doc_id long, text string, lang string")
        kept = {r.doc_id for r in langid.recognised(df).collect()}
        assert kept == {d for d, t, _ in data if t and any(c.isalpha() for c in t)}
        net = langid.train(langid.training_sample(df))
        held = langid.training_sample(df)[::5]
        low = langid.level(net, held)
        assert 1 / len(langs) <= low <= 1 / len(langs) + langid.STANDS_OUT * (1 - 1 / len(langs)) + 1e-9
    assert langid.train(langid.training_sample(df)).f.uz.shape[0] == max(langid.HIDDEN, 2 * len(langs))


def test_level_is_set_by_all_labelled_documents(spark):
    """Beyond the sample the threshold follows every document not learned from; a table within the sample keeps its level."""
    words = {"en": "the quick brown fox jumps over the lazy dog", "fi": "nopea ruskea kettu hyppii laiskan koiran yli"}
    df = spark.createDataFrame([(i, words[k] + f" {i}", k) for i in range(600) for k in words], "doc_id long, text string, lang string")
    rows, sample = langid.slices(df), langid.training_sample(df, per_lang=60)
    held = sample[4::5]
    net = langid.train([r for i, r in enumerate(sample) if i % 5 != 4])
    assert rows.count() > 5 * len(sample) > 0
    known = {(r.lang, r.h, r.part) for r in sample}
    rest = [r for r in rows.collect() if (r.lang, r.h, r.part) not in known] + held
    assert abs(langid.level_of_all(net, sample, held, rows) - langid.level(net, rest)) < 0.02
    everything = langid.training_sample(df)
    assert langid.level_of_all(net, everything, everything[4::5], rows) == langid.level(net, everything[4::5])


def test_python_stages_bound_the_bytes_of_a_batch(spark):
    """Rows of long texts come in batches of bounded size, and a bound that the session sets stays."""
    bound = 4 << 20

    def sizes(batches):
        for b in batches:
            yield b.assign(doc_id=int(b["text"].str.len().sum())).head(1)[["doc_id"]]

    for name in ("language", "near_dedup", "decontaminate", "shard"):
        session = spark.newSession()
        session.conf.set("spark.sql.shuffle.partitions", 2)
        docs = session.range(0, 300, 1, 1).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit("a").alias("source"),
                                                  F.concat(F.col("id").cast("string"), F.lit(" w"), F.repeat(F.lit("x"), 50_000)).alias("text"))
        assert max(r.doc_id for r in docs.mapInPandas(sizes, "doc_id long").collect()) > 2 * bound
        dict(corpus_pipeline.STAGES)[name](session, docs, SF001)
        got = [r.doc_id for r in docs.mapInPandas(sizes, "doc_id long").collect()]
        assert sum(got) > 300 * 50_000 and max(got) <= bound + 60_000, name
    session.conf.set(BATCH_KEY, "1m")
    corpus_pipeline.shard(session, docs, SF001)
    assert session.conf.get(BATCH_KEY) == "1m"
