"""Offers as a stream: each micro-batch is validated, and accepted items and rejects go to tables of their own; ``writes.ingest`` resolves them to products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import writes
from ..schema import OFFER_ITEM


def read_items(spark: SparkSession, folder: str, files_a_trigger: int = 100) -> DataFrame:
    """JSON lines of offer items as they arrive."""
    return spark.readStream.schema(OFFER_ITEM).option("maxFilesPerTrigger", files_a_trigger).json(folder)


def promo_counts(items: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Offers and mean price of each type of promotion by the hour of the scrape; later rows than the watermark are left out."""
    rows = items.withWatermark("scraped_at", late).groupBy(F.window("scraped_at", window).alias("w"), "promo_type")
    return rows.agg(F.count("*").alias("offers"), F.round(F.avg(F.col("price").cast("double")), 2).alias("avg_price")).select(F.col("w.start").alias("start"), "promo_type", "offers", "avg_price")


def write_batches(items: DataFrame, accepted: str, rejected: str, checkpoint: str, once: bool = True):
    """Starts the stream. A batch is written under its own number, so one that runs again replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        good, bad = writes.split_offers(batch)
        good.write.mode("overwrite").parquet(f"{accepted}/batch={epoch}")
        bad.write.mode("overwrite").json(f"{rejected}/batch={epoch}")

    stream = items.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
