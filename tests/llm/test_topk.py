import numpy as np
import pyarrow as pa
import pytest

from scrubline.llm.topk import _finder, exact_top_k


def brute(rows, k):
    clean = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    unit = [(i, v / np.sqrt((v * v).sum()) if v.any() else v) for i, v in clean]
    out = {}
    for q, u in unit:
        scored = sorted((-round(float(sum(a * b for a, b in zip(u, v))), 6) + 0.0, i) for i, v in unit if i != q)
        out[q] = [(i, -s + 0.0) for s, i in scored[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["neighbor_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


@pytest.mark.parametrize("n,k,block", [(120, 5, 16), (40, 60, 7), (300, 1, 64)])
def test_like_brute_force(spark, n, k, block):
    rng = np.random.Generator(np.random.PCG64(n))
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8)]) for i in range(n)]
    assert found(exact_top_k(frame(spark, rows), k=k, block=block)) == brute(rows, k)


def test_ties_are_broken_by_id(spark):
    rows = [(i, [1.0, 0.0] if i % 3 else [0.0, 1.0]) for i in range(60)]
    assert found(exact_top_k(frame(spark, rows), k=7, block=8)) == brute(rows, 7)


def test_rows_that_are_no_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, []), (None, [1.0, 1.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [0.0, 0.0]), (7, [1.0, 1.0]), (8, [float("inf"), 1.0])]
    df = frame(spark, rows).selectExpr("*", "1 as id", "2 as score", "3 as b")
    assert found(exact_top_k(df, k=3)) == brute(rows, 3)
    assert exact_top_k(df.limit(0), k=3).count() == 0


def test_queries_apart_from_the_vectors(spark):
    base, asked = frame(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])]), frame(spark, [(1, [1.0, 0.1])])
    assert [i for i, _ in found(exact_top_k(base, asked, k=2))[1]] == [1, 2]


def test_a_querys_own_id_is_left_out_if_asked(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=4)]) for i in range(90)]
    df = frame(spark, rows)
    want = brute(rows, 4)
    assert found(exact_top_k(df, df.filter("vec_id % 20 = 0"), k=4, block=8, leave_out_own=True)) == {q: want[q] for q in range(0, 90, 20)}


def test_many_equal_vectors_send_k_of_each_block_to_the_ranking(spark):
    """20,000 equal vectors tie with each other: a query and block send k rows, not a row for each vector."""
    n, k, block = 20_000, 3, 1024
    df = spark.range(n).selectExpr("id as vec_id", "array(1.0F, 2.0F, 3.0F) as embedding").repartition(4)
    out = exact_top_k(df, df.filter("vec_id % 2000 = 7"), k=k, block=block)
    got = found(out)
    assert got == {q: [(i, 1.0) for i in range(4) if i != q][:k] for q in range(7, n, 2000)}
    one = np.ones((block, 1)) / 1.0
    batch = pa.RecordBatch.from_arrays([pa.array([0]), *(pa.array([x], pa.binary()) for x in (np.arange(5).tobytes(), np.ones((5, 1)).tobytes())), pa.array([0]), pa.array([np.arange(block).tobytes()], pa.binary()), pa.array([one.tobytes()], pa.binary()), pa.array([np.full(5, -1.0).tobytes()], pa.binary())], ["qb", "qi", "qm", "b", "ids", "m", "lo"])
    (rows,) = _finder(1, True, k)([batch])
    assert rows.num_rows == 5 * k


@pytest.mark.parametrize("kind", ["string", "decimal(10,2)", "double"])
def test_ids_of_other_types_come_back_in_them(spark, kind):
    rows = [(i, [float((i * 7) % 11), float(i % 5), 1.0]) for i in range(30)]
    df = frame(spark, rows)
    other = df.selectExpr(f"cast(concat('0', vec_id + 100, '.5') as {kind}) as vec_id", "embedding")
    name = {r[0]: r[1] for r in df.selectExpr("vec_id", f"cast(concat('0', vec_id + 100, '.5') as {kind})").collect()}
    assert found(exact_top_k(other, k=4)) == {name[q]: [(name[i], s) for i, s in own] for q, own in brute(rows, 4).items()}
    assert dict(exact_top_k(other, k=4).dtypes)["query_id"] == kind


def test_lengths_that_differ_and_components_that_would_overflow(spark):
    rows = [(1, [1e200, 1e200]), (2, [1.0, 1.0]), (3, [1e-200, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.0, 0.0]), (6, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(exact_top_k(df, k=1))
    assert got == {1: [(2, 1.0)], 2: [(1, 1.0)], 3: [(4, 1.0)], 4: [(3, 1.0)]}
    long = [(i, [float(x) for x in np.random.Generator(np.random.PCG64(i)).normal(size=3000)]) for i in range(6)]
    assert found(exact_top_k(frame(spark, [(i, [float(np.float32(x)) for x in v]) for i, v in long]), k=2)) == brute([(i, [float(np.float32(x)) for x in v]) for i, v in long], 2)
