"""The entity operators on spans all over long texts, against brute force."""

import random
import time

import pytest
from pyspark.sql import functions as F

from scrubline.operators import entities
from scrubline.operators.entities import ENTITIES, TOKENS
from scrubline.plans import queries
from tests.compare import DATA


def best(found):
    """Of each span the entity that scores most, the first of equal ones, in order of appearance."""
    spans = list(dict.fromkeys((e[3], e[4]) for e in found))
    return [max((e for e in found if (e[3], e[4]) == s), key=lambda e: e[1]) for s in spans]


def anonymized(text, found):
    spans = [(a, b, s, TOKENS[g]) for g, s, _, a, b in found if g in TOKENS and 0 <= a < b <= len(text)]
    kept = {(a, b, t) for a, b, s, t in spans if not any(x <= a and y >= b and (z > s or (z == s and (x < a or y > b))) for x, y, z, _ in spans)}
    done = []
    for a, b, t in sorted(kept):
        if done and done[-1][2] == t and (a <= done[-1][1] or not text[done[-1][1] : a].strip()):
            done[-1] = (done[-1][0], max(done[-1][1], b), t)
        elif not done or b > done[-1][1]:
            done.append((max(a, done[-1][1]) if done else a, b, t))
    for a, b, t in reversed(done):
        text = text[:a] + t + text[b:]
    return text


def spans_all_over(text, rng):
    out = []
    for a in range(0, len(text), 12):
        for _ in range(rng.randint(1, 2)):
            out.append((rng.choice(["PER", "LOC", "ORG", "MISC"]), rng.choice([0.7, 0.85, 0.9]), "w", a + rng.randint(0, 1), a + rng.choice([5, 9, 14])))
    return out


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(3)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect() if r["text"] and len(r["text"]) < 8000]
    rows = [(i, t, spans_all_over(t, rng)) for i, t in docs]
    assert max(len(e) for *_, e in rows) > 300 and max(e[-1][4] for *_, e in rows) > 5000
    return rows, spark.createDataFrame(rows, f"doc_id long, text string, e {ENTITIES}").repartition(8).cache()


def got(df, column):
    return {r[0]: r[1] if isinstance(r[1], str) else [tuple(x) for x in r[1]] for r in df.select("doc_id", column).collect()}


def test_anonymize(made):
    rows, df = made
    assert got(df, entities.anonymize(F.col("text"), F.col("e"))) == {i: anonymized(t, e) for i, t, e in rows}


def test_selection(made):
    rows, df = made
    assert got(df, entities.filter_tags(F.col("e"), ("PER", "ORG"))) == {i: [x for x in e if x[0] in ("PER", "ORG")] for i, _, e in rows}
    assert got(df, entities.filter_confident(F.col("e"), 0.85)) == {i: [x for x in e if x[1] >= 0.85] for i, _, e in rows}
    assert got(df, entities.best_per_span(F.col("e"))) == {i: best(e) for i, _, e in rows}


def test_registered_query_goes_over_whole_texts(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    groups = ("PER", "LOC", "ORG", "MISC")
    want = {i: anonymized(t, [(groups[k % 4], 0.9, "", k * 10 + 2, k * 10 + 7) for k in range(len(t) // 10 + 1)]) for i, t in docs.items()}
    assert {r["doc_id"]: r["result"] for r in queries.QUERIES["anonymize_whole"](spark, DATA).collect()} == want
    assert any("<PERSON>" in x[1000:] for x in want.values())


def test_spans_that_nest_or_are_odd():
    from scrubline.operators.entities import anonymize_text

    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice("ab  c") for _ in range(30))
        found = [(rng.choice(["PER", "LOC", "ORG", "MISC"]), rng.choice([0.7, 0.85, 0.9]), "w", a, a + rng.randint(0, 12)) for a in (rng.randint(-1, 30) for _ in range(rng.randint(0, 9)))]
        assert anonymize_text(text, [(g, s, a, b) for g, s, _, a, b in found]) == anonymized(text, found)


def test_scores_and_spans_that_are_null(spark):
    nan = float("nan")
    e = [("PER", None, "w", 0, 9), ("LOC", 0.9, "w", 2, 4), ("LOC", nan, "w", 10, 14), ("ORG", float("inf"), "w", 11, 13), ("ORG", 0.1, "w", 20, 24), None, (None, 0.9, "w", 26, 28), ("PER", 0.9, "w", None, 28), ("PER", 0.9, "w", 29, 99)]
    rows = [(1, "0123456789" * 3, e), (2, "ab", None), (3, None, e), (4, "ab", []), (5, "", e)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, e {ENTITIES}")
    found = {r[0]: r[1] for r in df.select("doc_id", entities.anonymize(F.col("text"), F.col("e"))).collect()}
    assert found == {1: "0123456789<LOCATION>456789<ORGANISATION>456789", 2: "ab", 3: None, 4: "ab", 5: ""}
    spans = {r[0]: r[1] and [tuple(s) for s in r[1]] for r in df.select("doc_id", entities.resolve_spans(F.col("text"), F.col("e"))).collect()}
    assert spans == {1: [(10, 14, "<LOCATION>"), (20, 24, "<ORGANISATION>")], 2: None, 3: [], 4: [], 5: []}


@pytest.mark.parametrize("kind", ["apart", "nested"])
def test_time_grows_as_the_spans(spark, kind):
    """40,000 spans of one text, which took minutes when each was compared with each and each step copied what was done."""
    n = 40_000
    span = "i * 10 + 2 AS start, i * 10 + 7 AS `end`" if kind == "apart" else f"i AS start, {10 * n} - i AS `end`"
    df = spark.range(1).select(F.expr(f"repeat('abcde fghi', {n})").alias("text"), F.expr(f"transform(sequence(0, {n - 1}), i -> struct('PER' AS entity_group, 0.9D AS score, '' AS word, {span}))").alias("e"))
    began = time.monotonic()
    out = df.select(entities.anonymize(F.col("text"), F.col("e"))).first()[0]
    assert time.monotonic() - began < 20
    assert out == ("ab<PERSON>ghi" * n if kind == "apart" else "<PERSON>")
