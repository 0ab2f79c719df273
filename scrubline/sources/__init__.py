"""Texts from and to storage."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_SETTING, BATCH_BYTES, BATCH_DEFAULTS = "spark.sql.execution.arrow.maxBytesPerBatch", "8m", (str(64 << 20), f"{64 << 20}b", "64m", "64MB")


def read_texts(spark: SparkSession, path: str, format: str = "parquet", text_col: str = "text", streaming: bool = False, schema: str | None = None, **options) -> DataFrame:
    """A table of any format that Spark reads, with its text in ``text_col``. Format "text" makes one text of each line, "wholetext" of each file.

    A stream of files needs a ``schema``, except of texts.
    """
    if format == "wholetext":
        format, options = "text", options | {"wholetext": "true"}
    reader = (spark.readStream if streaming else spark.read).format(format).options(**options)
    if schema:
        reader = reader.schema(schema)
    rows = reader.load(path)
    return rows.withColumnRenamed("value", text_col) if format == "text" else rows


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` of Parquet files dealt out to all cores, if their row groups are fewer than these; else as they are.

    A row group is read by one task, so a small table in one of them would be one task's work. Footers are only read of as many files as
    there are cores, and a table of more files, as any large one is, is never shuffled.
    """
    from pyarrow import fs, parquet

    cores = rows.sparkSession.sparkContext.defaultParallelism
    files = rows.inputFiles()
    if not files or len(files) >= cores or not all(f.endswith(".parquet") for f in files):
        return rows
    groups = 0
    for f in files:
        system, name = fs.FileSystem.from_uri(f)
        groups += parquet.ParquetFile(name, filesystem=system).metadata.num_row_groups
    return rows.repartition(cores) if groups < cores else rows


def small_batches(spark: SparkSession) -> None:
    """Sets the session's batches to Python to BATCH_BYTES if it left Spark's default, so that a worker's memory doesn't grow with the tables."""
    if spark.conf.get(BATCH_SETTING) in BATCH_DEFAULTS:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def from_strings(spark: SparkSession, texts: Iterable[str | None], text_col: str = "text") -> DataFrame:
    """A few texts held in memory, with their places as ``id``."""
    return spark.createDataFrame(list(enumerate(texts)), f"id long, `{text_col}` string")


def html_pages(spark: SparkSession, path: str, html_col: str = "html", text_col: str = "text", token: str = "<HTML>") -> DataFrame:
    """Pages as texts: ``text_col`` is what stands between the tags of ``html_col``."""
    from ..operators.arrow_stage import html_to_text_column

    return spark.read.parquet(path).withColumn(text_col, html_to_text_column(F.col(html_col), token))


def write_texts(rows: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", partition_by: tuple[str, ...] = ()) -> None:
    """Writes a batch, in the row order of no particular kind; keep an id column to know the rows by."""
    rows.write.format(format).mode(mode).partitionBy(*partition_by).save(path)
