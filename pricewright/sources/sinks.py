"""Where results go: append-only offers, tables that are swapped whole, review lists and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Groupings that go out in one batch.
BATCH = 200
#: First letters of a key that are ranked together.
LETTERS = 12
#: The chains, and whether they are active.
SEED = (("AB", "ab", True), ("Lidl", "lidl", True), ("Masoutis", "masoutis", True), ("My Market", "my-market", True), ("Sklavenitis", "sklavenitis", False))


def seed_brands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, name, slug, "GR", active) for i, (name, slug, active) in enumerate(SEED, 1)], "id long, name string, slug string, country_code string, active boolean")


def append_offers(offers: DataFrame, path: str) -> None:
    """Snapshots are only ever added; Spark's committer makes the whole append visible or none of it."""
    offers.write.mode("append").parquet(path)


def swap_table(df: DataFrame, path: str) -> None:
    """Replaces a table: written beside it first, for the new rows may be made from the old ones."""
    spark, beside = df.sparkSession, f"{path.rstrip('/')}.next"
    df.write.mode("overwrite").parquet(beside)
    jvm, old = spark._jvm, f"{path.rstrip('/')}.old"
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(at(old), True)
    if fs.exists(at(path)):
        fs.rename(at(path), at(old))
    fs.rename(at(beside), at(path))
    fs.delete(at(old), True)


def write_review_queue(queue: DataFrame, path: str) -> None:
    """One file of JSON lines in order of the ids; it is for people, so it is small."""
    queue.orderBy("a_id", "b_id").coalesce(1).write.mode("overwrite").json(path)


def batches(payload: DataFrame, size: int = BATCH) -> DataFrame:
    """Groupings with the number of their batch, in order of their keys.

    Keys are ranked among those of equal first letters; the numbers of those, one row each, are summed up. So no task
    takes all groupings.
    """
    letters = F.substring("canonical_key", 1, LETTERS)
    rows = payload.withColumn("__letters", letters)
    sizes = rows.groupBy("__letters").agg(F.count("*").alias("__n"))
    before = sizes.select(F.col("__letters").alias("__l"), (F.sum("__n").over(Window.orderBy("__letters")) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__letters").orderBy("canonical_key")) - 1
    rows = rows.withColumn("__rank", rank).join(before, F.col("__letters").eqNullSafe(F.col("__l")))
    return rows.withColumn("batch", F.floor((F.col("__before") + F.col("__rank")) / size)).drop("__letters", "__l", "__before", "__rank")


def dry_run(payload: DataFrame, size: int = BATCH, most: int = 20_000) -> str:
    """The first batch as JSON, cut to so many characters."""
    rows = payload.orderBy("canonical_key").limit(size).toJSON().collect()
    return ("[" + ",".join(rows) + "]")[:most]
