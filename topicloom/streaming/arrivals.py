"""Pages that arrive as a stream: each micro-batch goes through the batch plan, and the first arrival of a page stays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.selection import keep_first, page_key


def new_pages(batch: DataFrame, published: DataFrame | None, order: str) -> DataFrame:
    """The batch's first row of each page that isn't published yet; rows without a key always stay."""
    rows = keep_first(batch, page_key(), [order]).withColumn("page_key", page_key())
    if published is None:
        return rows
    return rows.join(published.select("page_key").where("page_key <> ''"), "page_key", "left_anti").select(*rows.columns)


def follow(spark: SparkSession, source: str, schema: StructType, out: str, checkpoint: str, plan: Callable[[DataFrame], DataFrame], order: str = "ord") -> StreamingQuery:
    """Read parquet files as they land in source, apply plan and write what is new below out, one folder per micro-batch.

    A batch that runs again after a failure overwrites its own folder and is held only against older ones, so its result
    is the same. Of older batches only the page keys are read; one that can't be read fails the query.
    """

    def publish(batch: DataFrame, number: int) -> None:
        published = spark.read.schema("page_key string, batch long").parquet(out).where(F.col("batch") < number) if number else None
        new_pages(plan(batch), published, order).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(schema).parquet(source).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(publish).start()
