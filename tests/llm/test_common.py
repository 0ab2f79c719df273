import os
import subprocess
import sys

import pytest

from scrubline.llm import common
from scrubline.llm.common import Scratch, free_name, keyed, likely_in, within, with_ids, without


@pytest.mark.parametrize("exact,bits", [(1 << 19, 1 << 26), (0, 1 << 26), (0, 0)])
def test_rows_in_keys_pass_and_the_rest_is_apart(spark, monkeypatch, exact, bits):
    monkeypatch.setattr(common, "EXACT_KEYS", exact)
    monkeypatch.setattr(common, "MOST_FILTER_BITS", bits)
    df = spark.range(20_000).withColumnRenamed("id", "Key").selectExpr("Key", "Key * 2 as __in")
    keys = Scratch(spark, "test").write(spark.range(0, 20_000, 7).toDF("k"))
    some, others = likely_in(df, "Key", keys, apart=True)
    passed = {r["Key"] for r in some.collect()}
    assert set(range(0, 20_000, 7)) <= passed and passed.isdisjoint(r["Key"] for r in others.collect())
    assert some.count() + others.count() == 20_000
    if bits:
        assert len(passed) < 3200
    kept = without(df, "Key", keys)
    assert kept.columns == df.columns and {r["Key"] for r in kept.collect()} == set(range(20_000)) - set(range(0, 20_000, 7))


def test_no_keys(spark):
    keys = Scratch(spark, "test").write(spark.range(0))
    assert likely_in(spark.range(5), "id", keys).count() == 0 and without(spark.range(5), "id", keys).count() == 5


def test_rows_get_keys_in_the_order_of_their_ids(spark):
    df = spark.createDataFrame([(3, "c"), (1, "b"), (1, "a"), (None, "z"), (2, None)], "doc_id long, text string")
    rows = sorted(keyed(df, Scratch(spark, "test")).collect(), key=lambda r: r["__key"])
    assert [r["doc_id"] for r in rows] == [1, 1, 2, 3, None]
    assert keyed(df.filter("text > 'b'"), Scratch(spark, "test")).count() == 2
    assert free_name(df, "TEXT", "x", "x") == ["TEXT_", "x", "x_"]


@pytest.mark.parametrize("exact,bits", [(1 << 19, 1 << 26), (0, 1 << 26), (0, 0)])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_exactly_the_rows_in_keys(spark, monkeypatch, exact, bits, kind):
    monkeypatch.setattr(common, "EXACT_KEYS", exact)
    monkeypatch.setattr(common, "MOST_FILTER_BITS", bits)
    df = spark.range(5000).unionByName(spark.range(1).selectExpr("cast(null as bigint) as id")).selectExpr(f"cast(id as {kind}) as id", "id as n")
    keys = Scratch(spark, "test").write(spark.range(0, 5000, 3).selectExpr(f"cast(id as {kind}) as k"))
    assert {r["n"] for r in within(df, "id", keys).collect()} == set(range(0, 5000, 3))
    assert {r["n"] for r in without(df, "id", keys).collect()} == set(range(5000)) - set(range(0, 5000, 3)) | {None}


@pytest.mark.parametrize("exact", [1 << 19, 0])
@pytest.mark.parametrize("ids,kind", [(["1", "0", "01", "", None, "é", "1"], "string"), ([0.5, 1.2, 1.7, None, float("nan"), -3.0, 1.2], "double"), ([5, 3, 3, None, None, 1, 2], "bigint")])
def test_keys_of_ids_of_any_type(spark, monkeypatch, exact, ids, kind):
    """Found by broadcast or looked up by place, in the order of the ids, and without a shuffle of texts."""
    monkeypatch.setattr(common, "EXACT_KEYS", exact)
    df = spark.createDataFrame([(i, f"text {n}") for n, i in enumerate(ids)], f"Doc_Id {kind}, text string").repartition(3)
    rows = keyed(df, Scratch(spark, "test"), "Doc_Id", "text")
    assert "Exchange hash" not in (plan := rows._jdf.queryExecution().executedPlan().toString()) and "Exchange range" not in plan
    got = sorted(rows.collect(), key=lambda r: r["__key"])
    rank = [repr(r["Doc_Id"]) for r in df.repartition(1).sortWithinPartitions(df["Doc_Id"].asc_nulls_last()).collect()]
    assert [repr(r["Doc_Id"]) for r in got] == rank and len({r["__key"] for r in got}) == len(ids)
    assert rows.columns == ["Doc_Id", "text", "__key"] and dict(rows.dtypes)["Doc_Id"] == kind
    back = with_ids(rows.select("__key"), rows, "doc_id")
    assert sorted(repr(r["doc_id"]) for r in back.collect()) == sorted(map(repr, ids))


def test_tables_go_when_they_are_cleared(spark):
    mark = common.marked()
    table = Scratch(spark, "test").write(spark.range(3))
    folder = table.path.removeprefix("file://")
    assert os.path.exists(folder)
    common.clear(spark, mark)
    assert not os.path.exists(folder) and common.marked() == mark


def test_the_package_travels_as_a_file(spark, tmp_path):
    """Another Python finds the operators in the file that workers get, and in nothing else."""
    (tmp_path / "x.zip").write_bytes(common.package_zip())
    code = "import scrubline.llm.minhash as m, scrubline.plans.queries; print(m.__file__)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path / "x.zip")}, capture_output=True, text=True)
    assert str(tmp_path / "x.zip") in out.stdout, out.stderr
    code = """
from pyspark.sql import SparkSession
from scrubline.llm import common
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
common.send_package(spark)
common.send_package(spark)
def where(batches):
    import sys
    import pyarrow as pa
    for _ in batches:
        yield pa.RecordBatch.from_arrays([pa.array(sys.path)], ["path"])
print("found", spark.range(1).mapInArrow(where, "path string").filter("path like '%scrubline.zip%'").count())
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True)
    assert "found 1" in out.stdout, out.stderr
