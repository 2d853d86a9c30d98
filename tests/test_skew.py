"""Joins, windows and clusters that must give the plain result however rows are split."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from crawlgauge.operators import clusters as CL
from crawlgauge.operators import keywords as K
from crawlgauge.operators import quality, skew


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_previous_values_is_lag(spark):
    rng = random.Random(2)
    rows = [(f"k{rng.choice([0, 0, 0, 1, 2])}", rng.randrange(40), i, float(rng.randrange(9))) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, t int, tie int, v double").withColumn("period", F.floor(F.col("t") / 6))
    got = skew.previous_values(df, ["k"], ["t", "tie"], ["v"], "period").drop("period")
    lag = F.lag("v").over(Window.partitionBy("k").orderBy("t", "tie"))
    assert rows_of(got) == rows_of(df.drop("period").withColumn("prev_v", lag))


def leaders_one_by_one(sets, threshold=0.1, min_shared=3):
    """The sequential rule."""
    taken, out = set(), {}
    for a in sorted(sets):
        if a in taken:
            continue
        taken.add(a)
        out[a] = a
        for b in sorted(sets):
            if b in taken:
                continue
            shared, union = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if (union and shared / union >= threshold) or shared >= min_shared:
                taken.add(b)
                out[b] = a
    return out


def test_clusters_follow_the_sequential_rule(spark):
    """Many random sites of different density at once, with hot keywords."""
    rng = random.Random(3)
    shapes = [(60, 30, (0, 15)), (40, 60, (1, 6)), (50, 40, (10, 15)), (25, 8, (1, 4)), (30, 200, (3, 15)), (40, 20, (2, 9))]
    words, articles, expected = [], [], {}
    for s, (n, vocabulary, sizes) in enumerate(shapes * 3):
        sets = {i: set(rng.sample(range(vocabulary), min(vocabulary, rng.randint(*sizes)))) for i in range(n)}
        articles += [(f"s{s}", i) for i in sets]
        words += [(f"s{s}", i, f"w{w}", r + 1) for i, ws in sets.items() for r, w in enumerate(sorted(ws))]
        expected |= {(f"s{s}", i): leader for i, leader in leaders_one_by_one(sets).items()}
    table = spark.createDataFrame(words, "site string, doc long, term string, rank int")
    got = CL.clusters(spark.createDataFrame(articles, "site string, doc long"), table)
    assert {(r.site, r.doc): r.leader for r in got.collect()} == expected


def test_clusters_compare_with_the_leader_only(spark):
    """a-b and b-c are similar, a-c are not: {a, b}, {c}."""
    terms = {"a": "1 2 3 4 5 6 7 8 9 10 11 12", "b": "1 2 3 21 22 23 24 25 26 27 31 32", "c": "31 32 21 41 42 43 44 45 46 47 48 49"}
    words = [("s", d, w, i + 1) for d, ws in terms.items() for i, w in enumerate(ws.split())]
    table = spark.createDataFrame(words, "site string, doc string, term string, rank int")
    articles = spark.createDataFrame([("s", d) for d in terms], "site string, doc string")
    got = CL.clusters(articles, table)
    assert {r.doc: r.leader for r in got.collect()} == {"a": "a", "b": "a", "c": "c"}
    similarity = {r.doc: (r.shared, round(r.jaccard, 4)) for r in CL.leader_similarity(got, table).collect()}
    assert similarity == {"a": (12, 1.0), "b": (3, 0.1429), "c": (12, 1.0)}


def test_cluster_parameters(spark):
    table = spark.createDataFrame([("s", 1, "w", 1)], "site string, doc long, term string, rank int")
    with pytest.raises(ValueError):
        CL.clusters(table.select("site", "doc"), table, threshold=0)


@pytest.mark.parametrize("block,top_k,threshold,min_shared", [(7, 15, 0.1, 3), (4, 15, 0.1, 3), (25, 40, 0.5, 20), (10, 15, 0.3, 2), (50, 5, 0.1, 1)])
def test_blocks_give_the_same_clusters(spark, block, top_k, threshold, min_shared):
    rng = random.Random(block)
    words, articles, expected = [], [], {}
    for s in range(4):
        sets = {i: set(rng.sample(range(12 * (s + 1)), rng.randint(0, min(top_k, 12)))) for i in range(30)}
        articles += [(f"s{s}", i) for i in sets]
        words += [(f"s{s}", i, f"w{w}", r + 1) for i, ws in sets.items() for r, w in enumerate(sorted(ws))]
        expected |= {(f"s{s}", i): leader for i, leader in leaders_one_by_one(sets, threshold, min_shared).items()}
    table = spark.createDataFrame(words, "site string, doc long, term string, rank int")
    got = CL.clusters(spark.createDataFrame(articles, "site string, doc long"), table, threshold, min_shared, top_k, block=block)
    assert {(r.site, r.doc): r.leader for r in got.collect()} == expected


def test_a_long_chain_ends(spark):
    """20,000 articles, each similar to its neighbours only: every other one leads."""
    n = 20_000
    ids = spark.range(n).select(F.lit("s").alias("site"), F.col("id").alias("doc"))
    terms = ids.select("site", "doc", F.posexplode(F.array(*[F.concat(F.lit("w"), F.col("doc") * 3 + k) for k in range(6)])).alias("rank", "term")).withColumn("rank", F.col("rank") + 1)
    got = CL.clusters(ids, terms, threshold=0.5, min_shared=3, block=8000)
    assert got.where(F.col("leader") != F.col("doc") - F.col("doc") % 2).count() == 0 and got.count() == n


def test_a_term_of_all_articles_makes_few_candidates(spark):
    """Articles that share only their two most frequent terms never meet."""
    rows = [("s", d, t, i + 1) for d in range(300) for i, t in enumerate(["hot", "warm", *(f"w{d}-{k}" for k in range(13))])]
    table = spark.createDataFrame(rows, "site string, doc long, term string, rank int")
    sets = CL.term_sets(table, 15)
    probes = sets.where("doc >= 100")
    assert CL.candidates(probes, sets.where("doc < 100"), 15, 0.1, 3).count() == 0
    got = CL.clusters(table.select("site", "doc").distinct(), table, block=100)
    assert got.where("leader <> doc").count() == 0


def test_needed_overlap():
    assert CL.needed_overlap(15, 15, 0.1, 3) == 3
    assert CL.needed_overlap(5, 6, 0.1, 3) == 1
    assert CL.needed_overlap(15, 1, 0.1, 3) is None


def test_open_questions_are_a_substring_test(spark):
    rng = random.Random(7)
    parts = ["alpha", "betamax", "gammaray", "delta", "epsilons", "zetafunction", "a-b", "x"]
    docs = []
    for i in range(30):
        title = " ".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
        asked = ["what " + " ".join(rng.choice(parts)[rng.randint(0, 1):] for _ in range(rng.randint(1, 3))) + "?" for _ in range(3)]
        docs.append((f"s{i % 3}", i, title.upper() if i % 5 == 0 else title, asked))
    articles = spark.createDataFrame(docs, "site string, doc long, title string, h2_list array<string>")
    got = {(r.doc, r.pos) for r in K.open_questions(articles, ["what"]).collect()}
    expected = set()
    for site, doc, _, asked in docs:
        for pos, q in enumerate(asked):
            phrase = " ".join([t for t in q.lower().replace("?", "").split() if t != "what" and len(t) > 3][:3])
            if len(phrase) >= 8 and not any(phrase in t.lower() for s, _, t, _ in docs if s == site):
                expected.add((doc, pos))
    assert got == expected and expected


def test_worst_contrast_equals_all_pairs(spark):
    rng = random.Random(8)

    def colour():
        return "#" + "".join(rng.choice("0123456789abcdefABCDEF") for _ in range(rng.choice([3, 6])))

    css = []
    for s in range(12):
        texts = [colour() for _ in range(rng.randint(0, 6))]
        backs = [colour() for _ in range(rng.randint(0, 6))] + [t for t in texts if rng.random() < 0.4]
        body = "".join(f"--color-text-{i}: {c};" for i, c in enumerate(texts)) + "".join(f"--color-bg{i}:{c};" for i, c in enumerate(backs))
        css.append((f"s{s}", "a.css", body, texts, backs))

    def lum(c):
        c = c.lstrip("#")
        c = "".join(x * 2 for x in c) if len(c) == 3 else c
        ch = [int(c[i : i + 2], 16) / 255 for i in (0, 2, 4)]
        ch = [x / 12.92 if x <= 0.03928 else ((x + 0.055) / 1.055) ** 2.4 for x in ch]
        return 0.2126 * ch[0] + 0.7152 * ch[1] + 0.0722 * ch[2]

    expected = {}
    for site, _, _, texts, backs in css:
        ratios = [
            (max(lum(t), lum(b)) + 0.05) / (min(lum(t), lum(b)) + 0.05) for t in texts for b in backs if t.lower() != b.lower()
        ]
        if ratios:
            expected[site] = round(min(ratios), 6)
    files = spark.createDataFrame([c[:3] for c in css], "site string, path string, content string")
    got = {r.site: round(r.ratio, 6) for r in quality.worst_contrast(files).collect()}
    assert got == expected


def test_cannibalisation_with_a_hot_term(spark):
    rows = [("s", d, 1, "hot", 10.0 + d, 1.0) for d in range(20)] + [("s", 1, 2, "cold", 5.0, 1.0), ("s", 2, 2, "cold", 7.5, 1.0), ("s", 3, 2, "single", 1.0, 1.0)]
    table = spark.createDataFrame(rows, "site string, doc long, rank int, term string, score double, idf double")
    got = K.cannibalisation(table).collect()
    assert {(r.term, r.n_articles, r.winner_delta) for r in got} == {("hot", 20, 1.0), ("cold", 2, 2.5)}
    assert len(got) == 22


@pytest.mark.parametrize("period", ["day", "month", "year"])
def test_trailing_sums_are_a_range_frame(spark, period):
    rng = random.Random(6)
    start = datetime.datetime(2024, 1, 30)
    times = [start + datetime.timedelta(days=rng.randrange(90), hours=rng.choice([0, 0, 7])) for _ in range(400)]
    rows = [(f"k{rng.choice([0, 0, 0, 1, 2])}", t, i, rng.randrange(-9, 9)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "k string, t timestamp, tie int, v bigint")
    got = skew.trailing_sums(df, ["k"], "t", ["v"], "30 DAYS", period)
    want = {(k, t, i, v, sum(w for k2, t2, _, w in rows if k2 == k and t - datetime.timedelta(days=30) <= t2 <= t)) for k, t, i, v in rows}
    assert {tuple(r) for r in got.select("k", "t", "tie", "v", "sum_v").collect()} == want and got.count() == len(rows)
    assert skew.trailing_sums(df.limit(0), ["k"], "t", ["v"], "30 DAYS", period).count() == 0


TEXTS = [("s", 1, "alpha beta alpha beta gamma the 42 alpha"), ("s", 2, "alpha beta delta " * 40), ("t", 3, "ab of"), ("t", 4, "gamma"), (None, 5, "alpha beta"), ("t", 6, None)]


def grams_of(text):
    words = [w for w in (text or "").split() if w not in ("the", "of", "42", "ab")]
    return [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def term_articles(spark):
    schema = "site string, doc long, body_text string, word_count long"
    return spark.createDataFrame([(site, doc, text, len((text or "").split())) for site, doc, text in TEXTS], schema).repartition(3)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_terms_are_counted_inside_their_article(spark):
    """Nothing is shuffled beyond the input's own repartition."""
    articles = term_articles(spark)
    for least in (1, 2):
        got = K.article_terms(articles, min_tf=least)
        assert exchanges(got) == exchanges(articles)
        want = {(doc, t): (grams.count(t), grams.index(t)) for _, doc, text in TEXTS for grams in [grams_of(text)] for t in grams if grams.count(t) >= least}
        assert {(r.doc, r.term): (r.tf, r.first_pos) for r in got.collect()} == want


def test_documents_of_terms_are_counted_where_they_arrive(spark):
    """One shuffle, in rows of many terms; of the asked terms only, if there are any."""
    articles = term_articles(spark)
    got = K.document_frequency(articles)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert exchanges(got) == exchanges(articles) + 1 and "Sort " not in plan
    found = [(site, t) for site, _, text in TEXTS for t in set(grams_of(text))]
    assert {(r.site, r.term): r.df for r in got.collect()} == {k: found.count(k) for k in found}
    asked = spark.createDataFrame([("s", "alpha"), ("s", "alpha beta delta"), ("t", "nowhere"), ("t", "gamma")], "site string, term string")
    assert {(r.site, r.term): r.df for r in K.document_frequency(articles, asked=asked).collect()} == {("s", "alpha"): 2, ("s", "alpha beta delta"): 1, ("t", "gamma"): 1}


def test_only_repeated_terms_are_written_for_keywords(spark, monkeypatch):
    written = {}
    real = K.written_table

    def write(df, name):
        written[name] = real(df, name)
        return written[name]

    monkeypatch.setattr(K, "written_table", write)
    assert K.keywords(term_articles(spark), boost=False).count() > 0
    assert written["terms"].count() > 0 and written["terms"].where("tf < 2").count() == 0
