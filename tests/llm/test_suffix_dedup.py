import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scrubline.llm import common, suffix_dedup, textops
from scrubline.llm.suffix_dedup import common_prefix, longest_previous_factors, remove_repeats, repeated_windows, suffix_array, word_numbers
from tests.compare import DATA

SPACE = set("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f ")


def split(text):
    """(start, end) of each word in bytes of UTF-8, ASCII white space between."""
    raw, out, at = text.encode(), [], None
    for i, b in enumerate(raw + b" "):
        blank = chr(b) in SPACE if b < 128 else False
        if blank and at is not None:
            out.append((at, i))
            at = None
        elif not blank and at is None:
            at = i
    return raw, out


def brute(texts, k):
    """The texts, in order, without words in windows of k words that an earlier window, apart from it, equals."""
    first, out = {}, []
    for d, text in enumerate(texts):
        raw, spans = split(text)
        gone = [False] * len(spans)
        for w in range(len(spans) - k + 1):
            window = tuple(raw[a:b] for a, b in spans[w : w + k])
            at = first.setdefault(window, (d, w))
            if at != (d, w) and (at[0] != d or w - at[1] >= k):
                gone[w : w + k] = [True] * k
        kept, at, w = b"", 0, 0
        while w < len(spans):
            if not gone[w]:
                w += 1
                continue
            start = spans[w][0]
            while w < len(spans) and gone[w]:
                w += 1
            kept += raw[at:start]
            at = spans[w - 1][1]
            while at < len(raw) and raw[at] < 128 and chr(raw[at]) in SPACE:
                at += 1
        out.append((kept + raw[at:]).decode())
    return out


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 5 == 0 else f"w{i}" for i in range(12)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(4, 40))] for _ in range(6)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(rng.randint(0, 5)):
            words += rng.choice(passages)[rng.randint(0, 3) :] if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 30))]
        out.append("".join(w + rng.choice([" ", "\n", "  "]) for w in words))
    return out


@pytest.mark.parametrize("seed,hot", [(1, 4096), (2, 4096), (3, 1), (4, 2)])
def test_like_brute_force(spark, seed, hot):
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in remove_repeats(df, 10, hot_contexts=hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 10)


def test_real_documents_like_brute_force(spark):
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    got = {r["doc_id"]: r["text"] for r in remove_repeats(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    assert [got[i] for i, _ in rows] == brute([t for _, t in rows], 50)


def test_nulls_ties_and_other_columns(spark):
    passage = " ".join(f"p{i}" for i in range(12))
    rows = [(1, passage, 1), (1, passage, 2), (None, passage + " end", 3), (None, None, 4), (2, "", 5), (3, "few words", 6), (4, f"{passage} tail", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __key int").withColumn("__spans", F.lit("x")).withColumn("__data", F.lit("y"))
    out = remove_repeats(df, 10)
    assert out.columns == df.columns
    got = {r["__key"]: r["text"] for r in out.collect()}
    assert sorted([got[1], got[2]]) == ["", passage] and got[3] == "end" and got[4] is None and got[5] == "" and got[6] == "few words" and got[7] == "tail"
    assert remove_repeats(df.limit(0), 10).count() == 0


def test_one_very_long_text_that_repeats_itself(spark):
    block = [f"u{i}" for i in range(30_000)]
    text = " ".join(block + ["mid"] + block)
    (row,) = remove_repeats(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row["text"] == " ".join(block + ["mid"]) + " "
    (row,) = remove_repeats(spark.createDataFrame([(1, "a " * 5000)], "doc_id long, text string")).collect()
    assert row["text"] == brute(["a " * 5000], 50)[0]


def test_longest_previous_factors():
    rng = np.random.Generator(np.random.PCG64(5))
    for n in (1, 2, 30, 200):
        s = rng.integers(0, 3, n)
        order, ranks = suffix_array(s, n)
        lcp = np.zeros(n, np.int64)
        lcp[1:] = common_prefix(order[:-1], order[1:], ranks, n)
        length, source = longest_previous_factors(order, lcp)
        for i in range(n):
            best = max((next((m for m in range(n - i + 1) if m == n - i or s[j + m] != s[i + m]), 0) for j in range(i)), default=0)
            assert length[i] == best
            assert not best or (source[i] < i and (s[source[i] : source[i] + best] == s[i : i + best]).all())


@pytest.mark.parametrize("bits", [1 << 26, 0])
def test_like_brute_force_when_keys_are_too_many_to_broadcast(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "EXACT_KEYS", 0)
    monkeypatch.setattr(common, "MOST_FILTER_BITS", bits)
    texts = corpus(5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in remove_repeats(df, 10).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 10)


@pytest.mark.parametrize("kind", ["string", "double"])
def test_ids_that_are_no_whole_numbers(spark, kind):
    """The text with the least id stays whole, one that nothing else has too."""
    passage = " ".join(f"p{i}" for i in range(12))
    df = spark.createDataFrame([("0", passage), ("1.7", passage), ("1.2", "only this " * 3)], "i string, text string").selectExpr(f"cast(i as {kind}) as doc_id", "text")
    out = remove_repeats(df, 10)
    assert out.dtypes == df.dtypes and {str(float(r["doc_id"])): r["text"] for r in out.collect()} == {"0.0": passage, "1.7": "", "1.2": "only this " * 3}


def test_words_are_told_by_bytes_when_their_hashes_collide():
    raw = np.frombuffer(b"aa bb aa b bb ccc aa ddd", np.uint8)
    starts, ends, hashes, _ = textops.words(raw, np.array([0, len(raw)]), suffix_dedup.SPACE)
    for h in (hashes, hashes % np.uint64(2), np.zeros_like(hashes)):
        number = word_numbers(raw, starts, ends, h)
        words = [bytes(raw[a:b]) for a, b in zip(starts, ends)]
        assert all((number[i] == number[j]) == (words[i] == words[j]) for i in range(len(words)) for j in range(len(words)))


@pytest.mark.parametrize("modulus", [1, 3, 1 << 20])
def test_windows_of_a_part_are_right_whatever_the_hashes(monkeypatch, modulus):
    real = textops.words
    monkeypatch.setattr(suffix_dedup, "words", lambda *a: (*(r := real(*a))[:2], r[2] % np.uint64(modulus), r[3]))
    rng = random.Random(modulus)
    texts = [" ".join(rng.choice("abc") + rng.choice("xy") for _ in range(40)) for _ in range(8)] + ["ax bx cx ay by cy " * 5] * 2
    spans = repeated_windows([t.encode() for t in texts], np.arange(len(texts)), np.zeros(len(texts), int), 4)
    got = []
    for t, own in zip(texts, spans):
        gone = np.zeros(len(t.encode()) + 1, bool)
        for a, b in own:
            gone[a:b] = True
        got.append([not gone[a] for a, _ in split(t)[1]])
    first, want = {}, []
    for d, t in enumerate(texts):
        w = t.split()
        keep = [True] * len(w)
        for i in range(len(w) - 3):
            at = first.setdefault(tuple(w[i : i + 4]), (d, i))
            if at != (d, i) and (at[0] != d or i - at[1] >= 4):
                keep[i : i + 4] = [False] * 4
        want.append(keep)
    assert got == want


def test_a_hot_passage_between_many_surroundings(spark):
    """An anchor with thousands of contexts: a passage that 6000 documents have, each between words of its own."""
    passage = " ".join(f"p{i}" for i in range(14))
    texts = [f"a{i} b{i} {passage} c{i} d{i}" for i in range(6000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["text"] for r in remove_repeats(df, 12).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, 12)
