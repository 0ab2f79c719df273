"""Cleaning of streams. All steps work row by row, so a stream needs neither state nor watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import CleanConfig
from ..plans.pipeline import clean


def clean_stream(rows: DataFrame, text_col: str = "text", cfg: CleanConfig | None = None, prefix: str = "") -> DataFrame:
    """``clean`` over a stream; refuses a batch, so that a plan isn't run as one by mistake."""
    if not rows.isStreaming:
        raise ValueError("rows must be a stream")
    return clean(rows, text_col, cfg, prefix)


def write_stream(rows: DataFrame, path: str, checkpoint: str, format: str = "parquet", once: bool = True) -> StreamingQuery:
    """Appends a stream to files. With ``once`` what has arrived is written and the query ends. ``checkpoint`` is a folder that all executors share."""
    writer = rows.writeStream.format(format).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start(path)
