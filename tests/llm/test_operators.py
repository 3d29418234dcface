"""Each operator against a brute-force version, on odd rows, on an empty table and on the
small tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from llm_rows import SF001, none, odd, odd_rows  # noqa: F401

from kgflow.llm import decontam, kn_quality, langid, line_dedup, mixing, multi_index, sharding, simhash, token_counts, url_filter
from kgflow.llm.queries import QUERIES, SQL_OP7
from kgflow.plans.check import compare

WS = " \t\n\x0b\x0c\r"


def docs_of(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.select("doc_id", "text", "lang", "source").collect()]


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


# ---- 1
def check_shards(rows, out, n):
    size = Counter((d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows)
    assert Counter((r.id, r.size, r.text_crc32) for r in out) == size
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < n
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    place = defaultdict(set)
    for r in out:
        place[r.size, r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in place.values())


def test_shards(odd, small, none):
    for df, n in ((odd, 24), (small, 24), (small, 5), (none, 24)):
        check_shards(docs_of(df), sharding.assign_shards(df, n).collect(), n)


def test_shards_balance(spark):
    rng = random.Random(1)
    rows = [(i, "a" * rng.randrange(1, 400) + str(i)) for i in range(4000)] + [(9000 + i, "hot") for i in range(3000)]
    out = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 6).collect()
    load = Counter()
    for r in out:
        load[r.shard] += r.size
    assert max(load.values()) < 1.02 * min(load.values())


def test_best_fit_decreasing_against_lists():
    rng = random.Random(2)
    for capacity in (50, 100, 1000):
        sizes = sorted((rng.randrange(1, 120) for _ in range(400)), reverse=True)
        room, bins = [], []
        for s in sizes:
            fits = [(r, i) for i, r in enumerate(room) if r >= s]
            if fits:
                _, i = min(fits)
            else:
                i = len(room)
                room.append(max(capacity, s))
            room[i] -= s
            if s >= capacity:
                room[i] = 0
            bins.append(i)
        assert sharding.pack(sizes, capacity) == bins


def test_one_large_group_is_alone():
    bins = sharding.pack_into([1000, *[10] * 50], 6)
    assert Counter(bins)[bins[0]] == 1 and max(Counter(bins[1:]).values()) == 10


# ---- 2
def test_token_counts(odd, small, none, monkeypatch):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(token_counts.tokenizer_path())
    for df, kw in ((odd, {}), (odd, {"chunk_chars": 4000, "overlap": 32}), (small, {"chunk_chars": 500, "overlap": 8}), (none, {})):
        want = Counter((d, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False))) for d, x, *_ in docs_of(df))
        assert Counter(map(tuple, token_counts.token_counts(df, **kw).collect())) == want


def test_piece_counter():
    t = token_counts._load(token_counts.tokenizer_path())
    c = token_counts.PieceCounter(t)
    texts = ["a  b\n\n c", " lead", "trail  ", "\u00a0x\u00a0 y\x1cz", "don't we'll\t'tis", "12 3.4e5 x1y2", "<|endoftext|> a<|endoftext|>b", "", "\u3000漢字 かな"]
    assert c.counts(texts) == [len(t.encode(x, add_special_tokens=False)) for x in texts]


def test_pieces_against_library_and_refusals(odd):
    t = token_counts._load(token_counts.tokenizer_path())
    rng = random.Random(3)
    signs = ["don't", "we'LL", "'s", "'", " ", "  ", "\n", "\t", "\r\n", "a", "É", "ß", "œ", "x1y2", "3.5", "...", "—", "\xa0", "\x1c", "\x85", "é", "İ", "漢字", "<|endoftext|>", "<|", "ª", "²", "_", "12", ", ", ". "]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(30))) for _ in range(5000)] + ["".join(rng.choice(signs[:17]) for _ in range(rng.randrange(30))) for _ in range(5000)]
    assert token_counts.PieceCounter(t).counts(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    with pytest.raises(ValueError):
        token_counts.token_counts(odd, path=token_counts.tokenizer_path("word_bpe_49k.json"))


# ---- 3
def brute_nearest(rows, k=10):
    ok = sorted({(i, tuple(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v) and len(v) == 8})
    x = np.array([v for _, v in ok])
    out = {}
    for i, v in ok:
        if i % 100 == 0:
            d = np.sqrt(((x - np.array(v)) ** 2).sum(1))
            out[i] = sorted((s, j) for s, (j, _) in zip(d, ok, strict=True) if j != i)[:k]
    return out


def test_nearest_exact_at_full_share_and_odd_vectors(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype("f4")]) for i in range(600)]
    rows += [(1000 + i, rows[5][1]) for i in range(50)] + [(2000, rows[5][1]), (2100, rows[5][1])]
    rows += [(3000, None), (3001, [0.0] * 8), (3002, [float("nan")] * 8), (3003, [None] * 8), (3004, [1.0] * 3), (None, [1.0] * 8), (3005, [float("inf")] * 8)]
    rows += [rows[3], rows[3]]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, id int, v int")
    want = brute_nearest(rows)
    got = defaultdict(list)
    for r in multi_index.search(df, F.col("id") % 100 == 0, share=1.0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id))
        assert r.rank == len(got[r.query_id])
    assert set(got) == set(want)
    for q in want:
        assert [v for _, v in got[q]] == [v for _, v in want[q]] and np.allclose([s for s, _ in got[q]], [s for s, _ in want[q]], atol=0, rtol=1e-12)


def test_nearest_recall_and_empty(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    got = defaultdict(set)
    for r in multi_index.search(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), F.col("id") % 100 == 0, min_candidates=1).collect():
        got[r.query_id].add(r.vec_id)
    x = np.array([v for _, v in rows], dtype=float)
    ids, hits, total = np.array([i for i, _ in rows]), 0, 0
    for q in np.flatnonzero(ids % 100 == 0):
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[ids[q]] & set(ids[np.argsort(d)[:10]].tolist()))
        total += 10
    assert hits / total >= 0.9
    assert multi_index.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 100 == 0).count() == 0


@pytest.mark.parametrize("dim,clusters", [(16, 0), (64, 0), (32, 40)])
def test_nearest_recall_beside_large_equal_groups(spark, dim, clusters):
    """6,000 vectors, three of them 7,000 times more: the copies don't take the centroids' places."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(6000, dim)) if not clusters else rng.normal(size=(clusters, dim))[np.arange(6000) % clusters] + rng.normal(scale=0.3, size=(6000, dim))
    x = x.astype("f4").astype(float)
    hot = [int(h) for h in rng.choice(6000, 3, replace=False)]
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    more = base.where(F.col("vec_id").isin(hot)).crossJoin(spark.range(7000)).select((10_001 + F.col("id") * 10 + F.col("vec_id") % 7).alias("vec_id"), "embedding")
    ids = np.array([*range(6000), *[10_001 + i * 10 + h % 7 for h in hot for i in range(7000)]])
    all_x = np.concatenate([x, *[np.repeat(x[h][None], 7000, axis=0) for h in hot]])
    got = defaultdict(set)
    for r in multi_index.search(base.unionByName(more), F.col("id") % 100 == 0).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 6000, 100):
        d = ((all_x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got[q] & set(ids[np.lexsort((ids, np.round(d, 12)))[:10]].tolist()))
    assert hits / 600 >= 0.9


def test_walk_is_by_rising_sum():
    rng = np.random.default_rng(1)
    d1, d2, n = rng.random(6), rng.random(5), rng.integers(0, 4, 30)
    order = sorted(range(30), key=lambda c: d1[c // 5] + d2[c % 5])
    assert multi_index.walk(d1, d2, n, 10 ** 9) == [c for c in order if n[c]]


# ---- 4
def test_decontamination_finds_copies_and_new_parameters(spark, none):
    rng = random.Random(4)
    filler = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(60))
    q = "a farmer named Alice sold 12 apples for 3 dollars each and then gave Alice and Bob another 12 apples to share between all of their friends"
    bench = spark.createDataFrame([(1, q), (2, "short item only"), (3, None), (4, ""), (5, "5 6 7 8 9 10 11 12 13 14")], "item_id long, text string")
    rows = [(1, f"{filler} {q} {filler}"), (2, filler), (3, q.replace("12", "40").replace("Alice", "Carol")), (4, q.replace("12 apples for", "9 apples for")),
            (5, None), (6, ""), (7, " ".join(q.split()[:9])), (8, f"{filler}\nShort item, only!"), (9, "1 2 3 4 5 6 7 8 9 10 11 12"), (None, q), (None, q), (3, q),
            (10, q.replace("gave", "gave quickly"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(0))
    got = {(r.id, r.item): r for r in decontam.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (3, 1), (4, 1), (8, 2), (None, 1), (10, 1)}
    assert got[1, 1].exact and got[None, 1].exact and got[1, 1].n_covered == got[1, 1].n_tokens
    assert got[4, 1].n_covered < got[1, 1].n_covered           # 12 -> 9 and 12 -> 12 clash
    assert sorted(r.doc_id for r in decontam.decontaminated(docs, bench).collect()) == [2, 5, 6, 7, 9]
    assert decontam.contaminated(none, bench).count() == 0
    assert decontam.decontaminated(docs, bench.limit(0)).count() == len(rows)


def test_decontamination_against_plain_search(spark, small):
    items = [(r.item_id, r.text.split()) for r in spark.read.parquet(f"{SF001}/benchmark.parquet").collect()]
    want = set()
    for d, t, *_ in docs_of(small):
        w = " ".join((t or "").split())
        want |= {(d, i) for i, x in items if " ".join(x) in w}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op4_decontamination"][0](spark, SF001).collect()}
    assert want and want <= got
    texts = {d: " ".join((t or "").split()) for d, t, *_ in docs_of(small)}
    for d, i in got - want:                                    # others share a long passage
        x = dict(items)[i]
        assert any(" ".join(x[k:k + 6]) in texts[d] for k in range(len(x) - 5))


def found_items(spark, items, texts):
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r.id, r.item) for r in decontam.contaminated(docs, bench).collect()}


def test_decontamination_finds_items_of_numbers_and_names(spark):
    rng = random.Random(14)
    filler = " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(20)) + "."
    items = ["Compute 12 + 7 * 3 - 5 / 2 + 9 * 4 - 16 / 8 + 21", "What is 12 times 15?",
             "Anna Meyer, Paul Schmidt, Karl Braun, Lisa Vogel und Otto Kern fahren am 3. Mai 2021 von Berlin nach Hamburg, Bremen, Kiel und Rostock.",
             "please add up these small whole numbers 1 2 3 4 5"]
    texts = [f"{filler} {t} {filler}" for t in items] + [f"{filler} {t.replace('12', '13').replace('Anna', 'Eva').replace(' 4 ', ' 6 ')} {filler}" for t in items]
    assert found_items(spark, items, texts) == {(0, 0), (1, 1), (2, 2), (3, 3), (6, 2)}         # other values in thin windows are other items


def test_decontamination_reads_texts_side_by_side():
    texts = ["", "Anna saw 3 red boats. Anna sold 2 of them in May to Paul Meyer", "one two", " \n\t ", "30 m", "m from the old harbour of Genoa at 5 km. Then\nLisa rowed back to it alone, in 12 minutes",
             "x", "Tom has three apples and Sam eats twenty-one of the apples that Tom bought on Monday", "Zwei\u3000Boote fuhren\x85nach Genua . . ! und 5 kg Fische dazu, sagte Anna leise", "  "]
    tok, bounds = decontam.Canon().together(texts)
    assert bounds[0] == 0 and len(bounds) == len(texts) + 1 and bounds[-1] == len(tok[1])
    alone = [next(decontam.Canon().tokens([t])) for t in texts]
    for w in (1, 2, 3, 8):
        at, h, reading = decontam.windows(tok, w, 5, bounds)
        of = np.searchsorted(bounds, at, side="right") - 1
        got = sorted(zip(of.tolist(), (at - bounds[of]).tolist(), h.tolist(), reading.tolist(), strict=True))
        assert got == sorted((i, *x) for i, t in enumerate(alone) for x in zip(*(c.tolist() for c in decontam.windows(t, w, 5)), strict=True))
    short = decontam.Canon().together(["a few words", "and some more", "30 m of rope"] * 3)         # no window within a text
    assert [len(x) for x in decontam.windows(short[0], 8, 5, short[1])] == [0, 0, 0]
    canon = decontam.Canon()
    assert [len(t[1]) for t in canon.tokens(texts)] == [0, 15, 2, 0, 2, 20, 1, 16, 13, 0] and len(canon.forms) == len(canon.ids)


def test_decontamination_of_numbers_written_out(spark):
    items = ["If three workers paint five large walls with seven cans of white paint, how many more cans does the whole old house need today?",
             "Wenn drei Arbeiter in vierundzwanzig Stunden eine hohe alte Mauer am Fluss bauen, wie lange brauchen dann alle anderen dort?",
             "Un marchand vend trente-deux petites pommes rouges et achète ensuite douze grandes poires vertes au marché couvert de la ville voisine"]
    paint, wall, fruit = items
    texts = [paint, paint.replace("three", "nine").replace("five", "two").replace("seven", "four"), paint.replace("three", "9").replace("five", "twenty-two").replace("seven", "40"),
             wall.replace("drei", "sieben").replace("vierundzwanzig", "dreißig"), fruit.replace("trente-deux", "vingt-et-un").replace("douze", "onze"),
             "There are three kinds of people, five large seas, seven hills of Rome, and two or four more things that nobody wants to count at all",
             "Once upon a time three workers had five large dogs and seven cans of beer, which the whole old house did not like at all"]
    assert found_items(spark, items, texts) == {(0, 0), (1, 0), (2, 0), (3, 1), (4, 2)}
    assert [decontam.is_number_word(w) for w in ("seventy-one", "fünfundzwanzig", "once", "two-faced", "one", "mil")] == [True, True, False, False, False, True]


def test_decontamination_does_not_depend_on_what_precedes(spark):
    items = ["Tom has 3 apples. Sam has 5 pears. Tom eats 2 apples. Sam buys 4 pears. How much fruit do Tom and Sam have now?",
             "What is the capital city of France and its river?",
             "Every morning the baker sells fresh bread. Tom then counts the coins slowly"]
    fruit, capital, baker = items
    texts = [fruit.replace("Tom", "Anna").replace("Sam", "Ben"), f"Here is one more, {capital} Nobody knows", f"and one more {capital}", f"It said: {capital}", f"we ask {capital.lower()}",
             f"he said every{baker[5:].replace('Tom', 'Eva')}", f"{capital[:-1]} system of lakes", "What is the largest small town of France and its river?"]
    assert found_items(spark, items, texts) == {(0, 0), (1, 1), (2, 1), (3, 1), (5, 2), (6, 1)}


# ---- 5
def test_quality_of_whole_texts(spark, odd, none):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(21, 0, 0), (22, 1, 1), (None, 1, 0), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = kn_quality.quality(odd, labels).collect()
    assert len(got) == odd.count()
    by = {r.id: r for r in got if r.id is not None}
    assert not by[300].keep and not by[301].keep and not by[302].keep and by[300].perplexity is None
    assert by[401].perplexity > by[3].perplexity and not by[401].keep and by[3].keep
    assert by[400].n_chars > 30_000
    assert kn_quality.quality(none, labels).count() == 0
    assert all(r.perplexity is None for r in kn_quality.quality(odd, labels.limit(0)).collect())


def brute_word_logs(taught, text):
    """Log probability of a text's units by dictionaries."""
    N, start = kn_quality.WORDS, kn_quality.START

    def grams(t):
        u = [start] * (N - 1) + re.findall(kn_quality.UNIT, t)
        return [tuple(u[i:i + N]) for i in range(len(u) - N + 1)]
    c = {N: Counter(g for t in taught for g in grams(t))}
    for n in range(N - 1, 0, -1):
        c[n] = Counter(g[1:] for g in c[n + 1])

    def prob(g):
        n = len(g)
        if n == 0:
            return 1 / (len(c[1]) + 1)
        d = kn_quality._discounts(Counter(c[n].values()))
        ext = [v for x, v in c[n].items() if x[:-1] == g[:-1]]
        if not ext:
            return prob(g[1:])
        own, total = c[n][g], sum(ext)
        return (own - d[min(own, 3) - 1] if own else 0) / total + sum(d[min(v, 3) - 1] for v in ext) / total * prob(g[1:])
    return [np.log(prob(g)) for g in grams(text)]


def word_quality(spark, texts, trusted, langs=None):
    docs = spark.createDataFrame([(i, t, langs[i] if langs else "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in trusted], "doc_id long, quality int, toxic int")
    return {r.id: r for r in kn_quality.quality(docs, labels).collect()}


def test_word_model_matches_dictionaries(spark):
    rng = random.Random(15)
    words = "the cat sat on a mat and dog log house is green 1 27 . ,".split()
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 30))) for _ in range(40)] + ["unseen zebra the cat", "the", "unseen", "", " \n", "the", "the"]
    got = word_quality(spark, texts, range(30))
    half = {r.id: r.h for r in spark.createDataFrame(list(enumerate(texts)), "id long, t string").selectExpr("id", "pmod(xxhash64(t), 2) as h").collect()}
    for i, t in enumerate(texts):
        want = brute_word_logs([texts[j] for j in range(30) if half[j] != half[i]], t)
        assert got[i].perplexity is None if not want else np.isclose(got[i].perplexity, np.exp(-np.mean(want)), rtol=1e-9)
        assert want or not got[i].keep


def test_quality_sees_shuffled_words(spark):
    rng = random.Random(16)
    nouns, verbs, ends = "cat dog farmer baker child bird".split(), "sees helps follows greets".split(), "today quietly again".split()
    good = [" ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)} the old {rng.choice(nouns)} {rng.choice(ends)}." for _ in range(12)) for _ in range(120)]
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in good[100:]]
    got = word_quality(spark, good + shuffled, range(100))
    assert sum(got[i].keep for i in range(100, 120)) >= 18
    assert not any(got[i].keep for i in range(120, 140))


def test_quality_judges_every_script(spark):
    rng = random.Random(17)
    frames = {"ru": ("{} видит старый {} и тихо говорит.", "Кот Дом Мальчик Сосед Учитель".split(), "дом сад лес город".split()),
              "el": ("{} βλέπει το παλιό {} και μιλάει.", "Γιάννης Νίκος Δάσκαλος Γείτονας".split(), "σπίτι δάσος χωριό".split()),
              "zh": ("{}今天看见了那个旧的{}，很高兴。", "老师 学生 邻居 孩子".split(), "房子 花园 城市".split()),
              "ar": ("{} يرى {} القديم ويتكلم بهدوء.", "الولد المعلم الجار".split(), "البيت الشارع السوق".split())}
    texts, langs, bad, bad_langs = [], [], [], []
    for lang, (frame, a, b) in frames.items():
        texts += (good := [" ".join(frame.format(rng.choice(a), rng.choice(b)) for _ in range(12)) for _ in range(60)])
        langs += [lang] * 60
        for t in good[:5]:
            bad += ["".join(rng.sample(t, len(t)))]                                  # the same characters, shuffled
            bad_langs += [lang]
    got = word_quality(spark, texts + bad, range(len(texts)), langs + bad_langs)
    assert sum(got[i].keep for i in range(len(texts))) >= 0.9 * len(texts)
    assert not any(got[i].keep for i in range(len(texts), len(texts) + len(bad)))
    assert len(re.findall(kn_quality.UNIT, "don’t 漢字 かな 12")) == 9


def test_quality_in_rounds_takes_little_disk(spark, monkeypatch):
    rng = random.Random(18)
    words = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(400)]
    texts = [" ".join(rng.choices(words, range(400, 0, -1), k=500)) for _ in range(80)]
    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))

    def used():
        return sum(f.stat().st_size for f in folder.rglob("*.parquet") if "/staged/kn-" in str(f))
    once = word_quality(spark, texts, range(0, 80, 2))
    monkeypatch.setattr(kn_quality, "ROUNDS", 2)
    monkeypatch.setattr(kn_quality, "ONE_ROUND", 0)
    before = used()
    got = word_quality(spark, texts, range(0, 80, 2))
    assert all(np.isclose(got[i].perplexity, once[i].perplexity, rtol=1e-12) and got[i].keep == once[i].keep for i in range(80))
    assert used() - before < 1.5 * sum(map(len, texts))             # counts and model as rows of hashes took more


def test_blocks_keep_every_triple():
    texts = ["a b a", "", " ", "b", "c a b a c"]
    frames = [pd.DataFrame({"tk": range(i, i + len(x)), "t": x}) for i, x in ((0, texts[:2]), (2, texts[2:]))]
    (names, (a, b, c, row), docs), = kn_quality._blocks(iter(frames))
    assert docs["units"].tolist() == [3, 0, 0, 1, 5] and docs["tk"].tolist() == [0, 1, 2, 3, 4]
    assert np.bincount(row, minlength=5).tolist() == [4, 0, 0, 2, 6]
    often = {int(names[b[1]]): 3}
    dealt = list(kn_quality._dealt(names, a, b, 4, often))
    assert sorted(np.concatenate([at for _, at in dealt]).tolist()) == list(range(len(a)))
    arrays = [names, a, np.zeros(0, np.int8), row.astype(np.float64)]
    assert all(np.array_equal(x, y) and x.dtype == y.dtype for x, y in zip(arrays, kn_quality.unpack(kn_quality.pack(*arrays)), strict=True))


# ---- 6
def brute_lines(rows):
    def key(x):
        return x.strip(WS).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    where = defaultdict(set)
    for d, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                where[key(x)].add(-(1 << 63) if d is None else d)
    out = Counter()
    for d, t, *_ in rows:
        lines = (t or "").split("\n")
        i = -(1 << 63) if d is None else d
        kept = [x for x in lines if not (len(where.get(key(x), ())) >= 3 and max(where[key(x)]) != i)]
        out[d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()] += 1
    return out


@pytest.mark.parametrize("parts", [3, 40])
def test_lines(spark, odd, none, tmp_path, parts):
    rng = random.Random(3)
    pool = [f"line number {i} that many documents may share" for i in range(60)]
    rows = [(rng.randrange(150) if i % 9 else None, "\n".join(rng.choices(pool[:1 + i % 60], k=rng.randrange(1, 9))), "en", "s") for i in range(300)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        for name, df in (("odd", odd.select("doc_id", "text", "lang", "source")), ("many", spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), ("none", none)):
            df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
            got = Counter(map(tuple, QUERIES["op6_line_dedup"][0](spark, f"{tmp_path}/{name}").collect()))
            assert got == brute_lines(docs_of(df))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_line_bitmaps(spark, odd):
    for r in line_dedup.keep_bitmaps(odd).collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(r.bitmap), dtype=np.uint8))
        assert (bits == 0).sum() == r.n_dropped > 0


# ---- 7
def test_urls(spark, duck001):
    r = compare(spark, SF001, QUERIES["op7_url_filter"][0], SQL_OP7, duck001)
    assert r["schema"] and r["values"], r["diff"]


def test_odd_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://A.NET", "http://a.net/", "https://x.Example.Net/en/1?q=/fr/", "https://example.net/en", "http://notexample.com/de/",
            "http://example.com/de/#x", "http://org/fr/", "ftp://b.org?x=://net/", "http://a.net:80/", "http://net/", "x://y://net/", "http://a.net\n/x"]
    rules = spark.sql("select * from values ('net','/','block'),('example.net','/en/','allow'),('example.com','/de/','block'),('org','/fr/','allow'),"
                      "('example.com','/de/','allow'),('',null,'block') as r(host,path,verdict)")
    df = spark.createDataFrame(list(enumerate(urls)) + [(None, urls[5]), (5, urls[5])], "page_id int, url string").withColumn("host", F.lit("clash"))
    table = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("", "", "block")]

    def judge(i, u):
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host):])[0]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for h, p, v in table if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        return i, host, path, best[1], best[2]

    want = Counter([judge(i, u) for i, u in enumerate(urls)] + [judge(None, urls[5]), judge(5, urls[5])])
    assert Counter(map(tuple, url_filter.judge_urls(df, rules).collect())) == want
    got = url_filter.judge_urls(df, rules, max_blocks=1).collect()
    assert Counter(map(tuple, got)) == want
    assert {r.verdict for r in url_filter.judge_urls(df, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0


def test_url_plan_has_no_python(spark):
    plan = QUERIES["op7_url_filter"][0](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


# ---- 8
def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in capped]
        if not free:
            return capped
        left = total - sum(capped.values())
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if t[s] > 3 * sizes[s]]
        if not over:
            return capped | t
        capped |= {s: 3.0 * sizes[s] for s in over}


def check_mix(rows, out):
    size = Counter()
    for d, t, _, s in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert len(out) == len(rows)
    targets, taken, largest = brute_targets(dict(size)), Counter(), Counter()
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(targets[r.source]) and 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
        largest[r.source] = max(largest[r.source], r.size)
    return targets, taken, largest


def test_mix(odd, small, none):
    for df in (small, odd, none):
        rows = docs_of(df)
        out = mixing.mix(df).collect()
        targets, taken, largest = check_mix(rows, out)
        for s, t in targets.items():
            assert abs(taken[s] - t) <= largest[s] + 1e-6
        assert Counter(map(tuple, out)) == Counter(map(tuple, mixing.mix(df.repartition(3)).collect()))


def test_mix_takes_some_of_equal_rows(spark):
    """One row, repeated 400 times, is half of a source: as many of its copies are taken as the target asks for."""
    rng = random.Random(4)
    rows = [(1, " ".join(["hot"] * 100), "a")] * 400 + [(i, " ".join(["w"] * rng.randrange(1, 200)), "a") for i in range(2, 400)]
    rows += [(1000 + i, " ".join(["v"] * rng.randrange(1, 200)), "b") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    out = mixing.mix(df).collect()
    targets, taken, largest = check_mix([(d, t, None, s) for d, t, s in rows], out)
    assert all(abs(taken[s] - t) <= largest[s] for s, t in targets.items())
    assert len({r.copies for r in out if r.id == 1}) <= 2
    got = mixing.mixed(df).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n")).collect()
    assert {r.source: r.n for r in got} == dict(taken)
    assert Counter(map(tuple, out)) == Counter(map(tuple, mixing.mix(df.repartition(3)).collect()))


def test_mixed_repeats_rows(odd):
    got = Counter((r.doc_id, r.text, r.source) for r in mixing.mixed(odd).collect())
    want = Counter()
    for r in mixing.mix(odd).collect():
        want[r.id, r.source] += r.copies
    have = Counter()
    for (d, _, s), n in got.items():
        have[d, s] += n
    assert +want == have and mixing.mixed(odd).columns == odd.columns


def test_targets_are_shared_by_weight(spark):
    for sizes in ({"a": 10, "b": 1, "c": 1000, None: 50}, {"a": 0, "b": 5}, {"a": 0}, {"x": 1}, {"a": 1, "b": 1, "c": 10 ** 6, "d": 1, "e": 2, None: 0}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.source_targets(df).collect()}
        assert got == pytest.approx(brute_targets(sizes))


# ---- 9
def test_gradients():
    rng = np.random.default_rng(0)
    net = langid.BiGru(["a", "b", "c"], hidden=4)
    for d in (net.f, net.b):
        for n in d.NAMES:
            setattr(d, n, getattr(d, n).astype(np.float64))
    net.w, net.bias = net.w.astype(float), net.bias.astype(float)
    seq = rng.integers(97, 105, (6, 5))
    seq[4:, 2] = langid.PAD
    target = np.array([0, 1, 2, 0, 1])
    _, grads = net.loss_and_gradients(seq, target)
    for p, g in zip(net.params(), grads, strict=True):
        for _ in range(6):
            i = tuple(rng.integers(0, s) for s in p.shape)
            if p.shape[0] == 257:
                i = (int(rng.integers(97, 105)), i[1])
            old = p[i]
            p[i] = old + 1e-5
            up = net.loss_and_gradients(seq, target)[0]
            p[i] = old - 1e-5
            down = net.loss_and_gradients(seq, target)[0]
            p[i] = old
            assert np.isclose((up - down) / 2e-5, g[i], rtol=1e-3, atol=1e-7)


def test_pooling_covers_every_byte():
    net = langid.BiGru(["a", "b"], hidden=4)
    text = ("abc def " * 60).encode()
    seq, _ = langid._windows([text])
    p = net.probabilities(seq)
    flat = np.concatenate([p[:, j] for j in range(p.shape[1])])[:len(text)]
    assert np.allclose(net.pool([b"zz", text])[1], flat.mean(axis=0), atol=1e-5)
    assert (net.label_positions(text) == flat.argmax(axis=1)).all()


def test_language_on_held_out_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.id: r for r in langid.identify(df).collect()}
    right = total = 0
    for r in df.collect():
        g = got[r.doc_id]
        assert g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= g.score <= 1
        if g.held_out and r.text and len(r.text) > 50:
            right, total = right + (g.lang_pred == r.lang), total + 1
    assert right / total > 0.95


def test_language_of_odd_rows(odd, none):
    got = langid.identify(odd).collect()
    assert len(got) == odd.count()
    by = {r.id: r for r in got if r.id is not None}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (300, 301, 302, 303))
    assert by[400].lang_pred in ("en", "de", "es") and not any(r.held_out for r in got if r.id is None)
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.recognised(odd)
    assert kept.columns == odd.columns and not {300, 301, 302, 303} & {r.doc_id for r in kept.collect()}


# ---- 10
def brute_simhash(rows):
    import xxhash
    out = []
    for d, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sh = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        out.append((d, sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))))
    fps = sorted({f for _, f in out})
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= 4:
                up[max(root(a), root(b))] = min(root(a), root(b))
    low = {}
    for d, f in out:
        r = root(f)
        low[r] = d if low.get(r) is None else low[r] if d is None else min(d, low[r])
    return Counter((d, f"{f:016x}", low[root(f)]) for d, f in out)


def test_simhash(spark, odd, small, none, tmp_path):
    rng = random.Random(8)
    base = " ".join(f"w{i}" for i in range(400)).split()
    near = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(4)):
            w[rng.randrange(400)] = f"n{rng.randrange(9)}"
        near.append((i, " ".join(w), "en", "s"))
    for name, df in (("odd", odd.select("doc_id", "text", "lang", "source")), ("small", small), ("near", spark.createDataFrame(near, "doc_id long, text string, lang string, source string")), ("none", none)):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        got = Counter(map(tuple, QUERIES["op10_simhash"][0](spark, f"{tmp_path}/{name}").collect()))
        assert got == brute_simhash(docs_of(df))


def test_simhash_bands_and_components(spark):
    rng = random.Random(6)
    fps = {rng.getrandbits(64) for _ in range(1500)}
    for f in list(fps)[:300]:                                  # chains of near fingerprints
        for _ in range(rng.randrange(1, 5)):
            f ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6)))
            fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x
    arr = np.array(sorted(fps), dtype=np.uint64)
    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr[i + 1:]) <= 4):
            a, b = root(int(arr[i])), root(int(arr[i + 1 + j]))
            up[max(a, b)] = min(a, b)
    want = defaultdict(set)
    for f in fps:
        want[root(f)].add(f)
    df = spark.createDataFrame([(s,) for s in signed], "fp long")
    for band in (32_768, 40):
        comp = defaultdict(set)
        for r in simhash.components(simhash.links(df, 4, band)).collect():
            comp[r.root].add(r.node % (1 << 64))
        assert sorted(map(sorted, comp.values())) == sorted(sorted(s) for s in want.values() if len(s) > 1)


def test_one_of_each(odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    marks = simhash.near_duplicates(odd).collect()
    assert kept.count() == len({r.root for r in marks})
    assert {r.doc_id for r in kept.collect()} <= {r.component_id for r in marks}


def test_close_pairs_against_all_pairs():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2 ** 63, 700, dtype=np.uint64)
    a[300:600] = a[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    b = a[::3] ^ np.uint64(9)
    want = {(int(x), int(y)) for x in a for y in b if int(x ^ y).bit_count() <= 4}
    got = {(int(x), int(y)) for p, q in simhash.close_pairs(a, b, 4, False) for x, y in zip(p, q, strict=True)}
    assert got == want


