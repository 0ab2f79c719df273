import numpy as np
import pytest

from scrubline.llm import common
from scrubline.llm.exact_dedup import cuts, drop_exact_duplicates, exact_duplicates, marks

TEXTS = ["same", "same", "other", "", "", None, None, "Same", "same "]


def brute(rows):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if t is not None and first.setdefault(t, i) != i:
            out.append((i, first[t]))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("bits", [128, 4, 1])
def test_like_brute_force_even_if_hashes_collide(spark, bits):
    rng = np.random.Generator(np.random.PCG64(1))
    letters = np.array(list("abcdefgh \né"))
    long = ["".join(rng.choice(letters, n)) for n in (200, 300, 5000, 40_000, 300_000)]
    near = [t[:-1] + "X" for t in long] + ["Y" + t[1:] for t in long]
    rows = list(enumerate(TEXTS + long + near + long[:3] + near[:2] + [long[0]]))
    got = sorted((r[0], r[1]) for r in exact_duplicates(frame(spark, rows), hash_bits=bits).collect())
    assert got == brute(rows)
    kept = {r["doc_id"] for r in drop_exact_duplicates(frame(spark, rows), hash_bits=bits).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in got}


def test_ids_that_are_null_or_repeat_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (None, "a", 3), (None, None, 4), (2, "b", 5)], "doc_id long, text string, __key int").selectExpr("*", "1 as key", "2 as hash")
    assert sorted((r[0] is None, r[0], r[1]) for r in exact_duplicates(df).collect()) == [(False, 1, 1), (True, None, 1)]
    out = drop_exact_duplicates(df)
    assert out.columns == df.columns and sorted(r["__key"] for r in out.collect())[1:] == [4, 5]
    assert exact_duplicates(df.limit(0)).count() == 0 and drop_exact_duplicates(df.limit(0)).count() == 0


def test_chunks_make_up_the_text_and_follow_the_content():
    rng = np.random.Generator(np.random.PCG64(7))
    data = rng.integers(97, 123, 200_000).astype(np.uint8)
    ends = cuts(data, 0, len(data), marks(data))
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes[:-1].min() >= 256 and sizes.max() <= 8192
    moved = np.concatenate([data[:1000][::-1], data])
    again = {e - 1000 for e in cuts(moved, 0, len(moved), marks(moved))}
    assert len(again & set(ends)) > 0.9 * len(ends)


IDS = [(["0", "1", "01"], "string"), ([0.5, 1.2, 1.7], "double"), (["0.5", "1.2", "1.7"], "decimal(5,1)"), (["b", "a", "é"], "string")]


@pytest.mark.parametrize("ids,kind", IDS)
def test_ids_that_are_no_whole_numbers(spark, ids, kind):
    df = spark.createDataFrame(list(zip(map(str, ids), ["copy", "only", "copy"])), "i string, text string").selectExpr(f"cast(i as {kind}) as doc_id", "text")
    out = drop_exact_duplicates(df)
    assert sorted(r["text"] for r in out.collect()) == ["copy", "only"] and out.dtypes == df.dtypes
    (pair,) = exact_duplicates(df).collect()
    copies = [r["doc_id"] for r in df.collect() if r["text"] == "copy"]
    assert [pair["kept_doc_id"], pair["doc_id"]] == sorted(copies)


@pytest.mark.parametrize("bits", [1 << 26, 0])
def test_like_brute_force_when_keys_are_too_many_to_broadcast(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "EXACT_KEYS", 0)
    monkeypatch.setattr(common, "MOST_FILTER_BITS", bits)
    rows = [(i, f"text {i % 40} " * (1 + i % 7)) for i in range(300)]
    assert sorted(tuple(r) for r in exact_duplicates(frame(spark, rows)).collect()) == brute(rows)
    kept = {r["doc_id"] for r in drop_exact_duplicates(frame(spark, rows)).collect()}
    assert kept == {i for i, _ in rows} - {i for i, _ in brute(rows)}
    texts = [(str(i), t) for i, t in rows]
    assert drop_exact_duplicates(spark.createDataFrame(texts, "doc_id string, text string")).count() == len({t for _, t in rows})
