"""Predictions as a stream: staging, progress, repeats."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.writers import append_staging


def stage(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append every micro-batch to the staging table."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, _: append_staging(df, path)).start()


def each(stream: DataFrame, call: Callable[[Row], None], checkpoint: str) -> StreamingQuery:
    """``call`` for every prediction as it comes, on the executors; a row may come again after a
    failure. An error of ``call`` stops the stream."""
    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreach(call).start()


def once(stream: DataFrame, keys: list[str], time: str, late: str = "1 day") -> DataFrame:
    """Without rows received again within ``late``."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def progress(rows: DataFrame, total: int | None = None) -> DataFrame:
    """``model, docs_done, docs_total, completed`` over a stream or a table, exactly: a stream
    keeps one entry of state for each document and model."""
    once_each = rows.select("model", "document_id").where("document_id IS NOT NULL").dropDuplicates(["model", "document_id"])
    done = once_each.groupBy("model").agg(F.count("*").alias("docs_done")) if rows.isStreaming else rows.groupBy("model").agg(F.countDistinct("document_id").alias("docs_done"))
    return done.select("model", "docs_done", F.lit(total).cast("bigint").alias("docs_total"), (F.col("docs_done") >= F.lit(total)).alias("completed"))


def throughput(stream: DataFrame, time: str, size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Predictions and cost of each model by event-time window; later rows are dropped."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(window.alias("w"), "model").agg(F.count("*").alias("n"), F.sum("llm_cost").alias("llm_cost")).select("w.start", "w.end", "model", "n", "llm_cost")
