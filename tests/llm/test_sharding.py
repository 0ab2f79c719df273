import pytest
from pyspark.sql import functions as F

from scrubline.llm.sharding import shard, write_shards
from tests.compare import DATA


def test_shards_are_contiguous_and_close_to_equal(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted(shard(docs, 7).collect(), key=lambda r: r["doc_id"])
    at, sizes = 0, [0] * 7
    for r in rows:
        assert r["byte_start"] == at
        at += r["n_bytes"]
        sizes[r["shard"]] += r["n_bytes"]
    assert [r["shard"] for r in rows] == sorted(r["shard"] for r in rows)
    assert max(abs(s - at / 7) for s in sizes) <= max(r["n_bytes"] for r in rows) + 7


def test_nulls_ties_empty_tables_and_clashing_columns(spark):
    rows = [(1, "abc"), (1, "é"), (None, "zz"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_bytes", "2 as __p", "3 as shard")
    got = [(r["doc_id"], r["n_bytes"], r["byte_start"]) for r in sorted(shard(df, 2).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"]))]
    assert got == [(1, 2, 0), (1, 3, 2), (2, 0, 5), (3, 0, 5), (None, 2, 5)]
    assert shard(df.limit(0), 3).count() == 0
    assert {r["shard"] for r in shard(df.withColumn("text", F.lit("")), 3).collect()} == {0}
    with pytest.raises(ValueError):
        shard(df, 0)


def test_written_shards_hold_all_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    write_shards(docs, f"{tmp_path}/out", 4)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == docs.count() and out.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0
    assert out.select(docs.columns).exceptAll(docs).count() == 0
    spans = out.groupBy("shard").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("shard").collect()
    assert all(x["b"] < y["a"] for x, y in zip(spans, spans[1:]))


def test_written_shards_of_odd_tables(spark, tmp_path):
    """Null, repeated and textual ids, null, empty and long texts, columns of the same names, nothing at all."""
    long = "long " * 100_000
    rows = [("b", "x", 1), ("b", "x", 2), ("a", None, 3), (None, "y", 4), (None, "y", 5), ("c", "", 6), ("01", "é" * 10, 7), ("1", long, 8)]
    df = spark.createDataFrame(rows, "Doc string, text string, Shard int").selectExpr("*", "1 as __key", "2 as __shard", "3 as __id")
    write_shards(df, f"{tmp_path}/a", 3, "Doc")
    out = spark.read.parquet(f"{tmp_path}/a")
    assert sorted(r["Shard"] for r in out.collect()) == list(range(1, 9)) and set(out.columns) == {*df.columns, "shard_"}
    where = {r["Shard"]: r["shard_"] for r in out.collect()}
    assert [where[n] for n in (7, 8, 3)] == sorted(where[n] for n in (7, 8, 3)) and where[4] == where[5] == max(where.values())
    write_shards(df.limit(0), f"{tmp_path}/b", 3, "Doc")
    assert spark.read.parquet(f"{tmp_path}/b").count() == 0
    assert shard(df, 3, "Doc").dtypes[0] == ("doc_id", "string") and shard(df, 3, "Doc").agg(F.max("byte_start")).first()[0] == 500_023


def test_many_rows_of_one_id_and_size_are_in_several_ranges(spark):
    """A third of all rows can't be told apart; each still has a place of its own."""
    df = spark.range(9000).selectExpr("if(id % 3 = 0, null, id) as doc_id", "'abc' as text")
    got = sorted(r["byte_start"] for r in shard(df, 8).collect())
    assert got == list(range(0, 27_000, 3))
