"""Contiguous shards of equal bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, col, free_name, keyed, ship_package


def prefix_sums(rows: DataFrame, order: list[Column], value: str, scratch: Scratch, start: str = "byte_start") -> tuple[DataFrame, int]:
    """``rows`` with, in ``start``, the sum of ``value`` over all rows before in ``order``; and the sum over all.

    Rows are put in ranges, sorted and written with the number of their partition; each partition's total
    goes to the driver (one number a partition), and the sums of the totals before come back. No task sees
    more than its own range.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id())
    fields = ranged.schema.simpleString().removeprefix("struct<").removesuffix(">")
    at = ranged.columns.index(value)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in batches:
            v = b.column(at).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(total + np.cumsum(v) - v, pa.int64())], [*b.schema.names, start])
            total += int(v.sum())

    table = scratch.write(ranged.mapInArrow(within, f"{fields}, `{start}` long"))
    totals = {r["__p"]: r["t"] for r in table.groupBy("__p").agg(F.sum(value).alias("t")).collect()}
    before, total = {}, 0
    for p in sorted(totals):
        before[p], total = total, total + totals[p]
    offsets = table.sparkSession.createDataFrame(list(before.items()) or [(-1, 0)], "__p int, __before long")
    return table.join(F.broadcast(offsets), "__p").withColumn(start, F.col(start) + F.col("__before")).drop("__p", "__before"), total


def shard(docs: DataFrame, n_shards: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's shard, as (doc_id, n_bytes, byte_start, shard), for shards contiguous in order of id.

    ``byte_start`` is the number of UTF-8 bytes of all documents before; shards are cut at multiples of
    ceil(total / ``n_shards``) bytes, and a document is in the shard in which it starts. So a shard's bytes are
    off the target by one document at most. Only ids and sizes are shuffled, never texts.

    Null texts have 0 bytes. Ids may be of any type that sorts, and are returned in it. A null id comes after all others. Rows with equal ids are ordered by size. Shards may be empty;
    if all texts are, all documents are in shard 0. No documents give no rows. Other columns are ignored.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be 1 or more")
    ship_package(docs.sparkSession)
    sizes = docs.select(col(id_col).alias("doc_id"), F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("tie"))
    order = [F.asc_nulls_last("doc_id"), F.asc("n_bytes"), F.asc("tie")]  # rows of equal id and size, which may be many, fall in several ranges
    sums, total = prefix_sums(sizes, order, "n_bytes", Scratch(docs.sparkSession, "shard"))
    target = max(1, -(-total // n_shards))
    return sums.select("doc_id", "n_bytes", "byte_start", F.least(F.expr(f"byte_start div {target}L"), F.lit(n_shards - 1)).cast("int").alias("shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 64, id_col: str = "doc_id", text_col: str = "text", **write) -> None:
    """Writes the documents in one folder a shard (``shard=N``), as ``shard`` cuts them in order of id.

    The driver gets the first key of each shard, ``n_shards`` numbers at most, and the documents find their shard by these. They are shuffled
    once, in ranges of their order, so that a large shard is several files and several tasks' work; each file is in order of id.

    Null ids come last, rows with equal ids in order of a hash of the text; each row is written once, null and empty texts too. Where
    ``docs`` has a column ``shard``, whatever its case, the folders are named by ``shard_`` and it stays. No documents give one table without rows or folders.
    """
    scratch = Scratch(docs.sparkSession, "shards")
    key, name = free_name(docs, "__key", "shard")
    rows = keyed(docs, scratch, id_col, text_col, key)
    firsts = shard(rows, n_shards, key, text_col).groupBy("shard").agg(F.min("doc_id").alias("first")).orderBy("shard").collect()
    if not firsts:
        docs.withColumn(name, F.lit(0)).limit(0).write.parquet(path, **write)
        return
    numbers, bounds = np.array([r["shard"] for r in firsts], np.int32), np.array([r["first"] for r in firsts], np.int64)

    @F.pandas_udf("int")
    def of(keys):
        import pandas as pd

        return pd.Series(numbers[np.searchsorted(bounds, keys.to_numpy(), "right") - 1])

    placed = rows.withColumn(name, of(col(key))).repartitionByRange(col(key)).sortWithinPartitions(col(name), col(key))
    placed.drop(key).write.partitionBy(name).parquet(path, **write)
