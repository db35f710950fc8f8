"""Streaming ingestion: files of pages in, facts and ledger rows appended, each page once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking, facts

PAGES = "document_id string, page_num int, text string, arrived timestamp"


def page_stream(spark: SparkSession, folder: str, late: str = "1 day") -> DataFrame:
    """Pages from Parquet files as they arrive; repeats of a page within the time of the watermark are dropped."""
    rows = spark.readStream.schema(PAGES).parquet(folder)
    return rows.withWatermark("arrived", late).dropDuplicatesWithinWatermark(["document_id", "page_num"])


def ingest(pages: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Chunks and facts of each batch, in folders by batch: a batch that is repeated after a failure replaces its own output."""

    def write(batch: DataFrame, number: int) -> None:
        ldus = chunking.buffer_ldus(batch.drop("arrived"))
        ldus.write.mode("overwrite").parquet(f"{out}/ldus/batch={number}")
        stored = batch.sparkSession.read.parquet(f"{out}/ldus/batch={number}")
        facts.extract(stored).write.mode("overwrite").parquet(f"{out}/facts/batch={number}")

    return pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def page_counts(pages: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Pages and characters by window of arrival."""
    return pages.groupBy(F.window("arrived", window)).agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"))
