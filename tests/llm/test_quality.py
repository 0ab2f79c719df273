import os
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scrubline.llm.common import Scratch
from scrubline.llm.quality import N_FEATURES, PAIRS, PREFIX, SHAPE_AT, WORD_BITS, drop_poor, features, learn, quantile, rank_documents, scores, train
from tests.compare import DATA

SF = os.path.join(os.path.dirname(DATA), "sf0.1") if os.path.basename(DATA) == "sf0.001" else DATA


def test_held_out_accuracy(spark):
    """Half of the labels are learnt from, the other half is judged."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").withColumn("half", F.pmod(F.hash("doc_id"), F.lit(2)))
    kept = rank_documents(docs, labels.filter("half = 0").drop("half")).select("doc_id", F.lit(1).alias("kept"))
    held = labels.filter("half = 1").withColumn("good", (F.col("quality") == 1) & (F.col("toxic") == 0)).join(docs, "doc_id").join(kept, "doc_id", "left")
    share = {r["good"]: r["share"] for r in held.groupBy("good").agg(F.avg(F.coalesce("kept", F.lit(0))).alias("share")).collect()}
    assert share[True] > 0.98 and share[False] < 0.08


def test_weights_follow_the_pairs_loss():
    """One feature apart: its weight must put the preferred above the others."""
    rows, ids = np.arange(40), np.array([3] * 20 + [7] * 20)
    w = learn(rows, ids, np.ones(40), np.arange(40) < 20)
    assert w[3] > 0 > w[7] and np.flatnonzero(w).tolist() == [3, 7]
    assert not learn(rows, ids, np.ones(40), np.ones(40, bool)).any() and len(w) == N_FEATURES


@pytest.mark.parametrize("q", [0.0, 0.003, 0.5, 1.0])
def test_quantiles_like_sorting(spark, q):
    rng = np.random.Generator(np.random.PCG64(2))
    values = [float(x) for x in np.round(rng.normal(size=3000), 2)] + [1e300, -5e-324]
    df = Scratch(spark, "test").write(spark.createDataFrame([(v,) for v in values], "v double"))
    assert quantile(df, "v", q, bins=16) == sorted(values)[max(1, int(np.ceil(q * len(values)))) - 1]
    assert quantile(df.limit(0), "v", q) is None


def test_nulls_ties_empty_tables_and_clashing_columns(spark):
    good = [(i, f"the quick fox {i} runs over the hill and home again", 0) for i in range(60)]
    bad = [(100 + i, f"$$$ ### buy {i} ### $$$ now !!! ###", 0) for i in range(60)]
    rows = good + bad + [(None, None, 1), (7, None, 2), (8, "", 3), (None, "the quick fox runs over the hill and home again", 4), (100, "$$$ ### ### $$$ !!!", 5), (100, "$$$ ### ### $$$ !!!", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __score int").selectExpr("*", "1 as score", "2 as good", "3 as id")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)] + [(None, 1, 0), (9999, 1, 1), (1, None, None), (2, 1, None)], "doc_id long, quality int, toxic int")
    out = drop_poor(docs, labels)
    assert out.columns == docs.columns
    marks = {r["__score"] for r in out.collect()}
    assert {1, 2, 3, 4} <= marks and not marks & {5, 6}
    listed = rank_documents(docs, labels)
    assert listed.filter("score is null").count() == 3 and listed.count() == out.count()
    assert drop_poor(docs, labels.filter("quality = 1")).count() == len(rows)  # one class only
    assert drop_poor(docs, labels.limit(0)).count() == len(rows) and rank_documents(docs.limit(0), labels).count() == 0


def bradley_terry(x, good, steps, rate=0.1, l1=1e-4, l2=0.1, seed=7):
    """Weights by following the slope, found by finite differences, of the mean logistic loss over pairs that are written out one by one."""
    g, b = np.flatnonzero(good), np.flatnonzero(~good)
    rng = np.random.Generator(np.random.PCG64(seed))
    pairs = [*zip(rng.choice(g, len(b) * PAIRS), np.repeat(b, PAIRS)), *zip(g, rng.choice(b, len(g)))]
    apart = np.array([x[i] - x[j] for i, j in pairs])

    def loss(v):
        return np.mean(np.log1p(np.exp(-apart @ v))) + l2 * (v @ v) / (2 * len(v))

    v = m = s = np.zeros(x.shape[1])
    for t in range(1, steps + 1):
        slope = np.array([(loss(v + e) - loss(v - e)) / 2e-5 for e in np.eye(len(v)) * 1e-5]) + l1 * np.sign(v)
        m, s = 0.9 * m + 0.1 * slope, 0.99 * s + 0.01 * slope**2
        v = v - rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-6)
    return v


def test_weights_like_those_of_the_pairs_written_out():
    rng = np.random.Generator(np.random.PCG64(3))
    x = rng.normal(size=(30, 6)) + np.outer(np.arange(30) < 18, [1.0, -1.0, 0.5, 0, 0, 0])
    rows, ids = np.nonzero(x)
    w = learn(rows, SHAPE_AT + ids, x[rows, ids], np.arange(30) < 18, steps=40)
    assert np.allclose(w[SHAPE_AT : SHAPE_AT + 6], bradley_terry(x, np.arange(30) < 18, 40), atol=1e-3)


def test_features_like_counting_words():
    """Values of hashed words and beginnings of words, by counting; texts with the same counts have the same features."""
    texts = ["a a bcdef BCDEZ", "", None, "x " * 3000, "été, a", "b a"]
    got = {}
    for i, j, r, ids, values, _ in features(pa.array(texts, pa.string())):
        for row, f, v in zip(r, ids, values):
            got.setdefault(i + int(row), Counter())[round(float(v), 9)] += 1
            assert 0 <= f < 2 << WORD_BITS
    for n, t in enumerate(texts):
        raw = [w for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).encode().split()]
        want = Counter()
        for counts in (Counter(raw), Counter(w[:PREFIX] for w in raw)):
            want.update(round(float(np.log1p(c) / (len(raw) + 20.0) ** 0.25), 9) for c in counts.values())
        assert got.get(n, Counter()) == want


def test_labels_of_unknown_documents_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(i, f"the quick fox {i} runs over the hill and home again") for i in range(60)] + [(100 + i, f"$$$ ### buy {i} ### $$$ now !!! ###") for i in range(60)] + [(1000 + i, None) for i in range(50)], "doc_id long, text string")
    known = [(i, 1, 0) for i in range(60)] + [(100 + i, 0, 0) for i in range(60)]
    labels = spark.createDataFrame(known + [(5000 + i, i % 2, 0) for i in range(20_000)] + [(1000 + i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in drop_poor(docs, labels, sample=50).collect()}
    assert not kept & set(range(100, 160)) and len(kept & set(range(60))) >= 59 and kept >= set(range(1000, 1050))


def test_a_labelled_id_that_many_rows_have_is_learnt_from_once(spark):
    rows = [(1, f"the quick fox runs home {i}") for i in range(3000)] + [(i, f"the slow fox {i} rests at home") for i in range(2, 40)] + [(100 + i, f"$$$ ### buy {i} $$$ !!!") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 40)] + [(100 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    weights, _ = train(docs, labels, Scratch(spark, "test"), "doc_id", "text")
    once, _ = train(docs.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text")), labels, Scratch(spark, "test"), "doc_id", "text")
    assert (weights == once).all() and weights.any()
    good, bad = (scores(pa.array([t]), weights)[0] for t in ("the quick fox rests at home", "$$$ ### buy $$$ !!!"))
    assert good > bad


@pytest.mark.parametrize("kind", ["string", "double"])
def test_ids_of_other_types_and_a_very_long_text(spark, kind):
    rows = [(f"{i}.5", f"the quick fox {i} runs over the hill and home again", 1) for i in range(40)] + [(f"{100 + i}.5", f"$$$ ### buy {i} ### $$$ now !!! ###", 0) for i in range(40)]
    rows += [("900.5", "the quick fox runs over the hill and home again " * 30_000, 1)]
    df = spark.createDataFrame(rows, "i string, text string, quality int").selectExpr(f"cast(i as {kind}) as doc_id", "text", "quality", "0 as toxic")
    out = drop_poor(df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic"))
    assert out.dtypes == [("doc_id", kind), ("text", "string")] and 40 <= out.count() <= 41
    assert dict(rank_documents(df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")).dtypes)["doc_id"] == kind
