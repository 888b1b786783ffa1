"""Shared folder, scratch tables and small helpers of the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: Rows and bytes that Spark hands a Python worker at once (Spark's own, ours), where the session doesn't say: texts are long, and both sides hold a batch whole.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m")}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a local session that names none gets a new one; elsewhere that is an error."""
    at = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_DIR} has to name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="pricewright-")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


class Scratch:
    """Tables written to the shared folder. A written table cuts lineage and survives a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, table: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(table))
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def finish(self, df: DataFrame) -> DataFrame:
        """The rows as the one table that is left; all others, which they were made from, go."""
        out = self.write(df, "result")
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for f in fs.listStatus(at):
            if f.getPath().getName() != "result":
                fs.delete(f.getPath(), True)
        return out


def on_executors(spark: SparkSession) -> None:
    """Lets Python workers started from here import this package, whatever folder the driver was started in, and bounds their batches."""
    for setting, (default, ours) in BATCHES.items():
        if spark.conf.get(setting, None) in (None, default):
            spark.conf.set(setting, ours)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that the table doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_local(path: str) -> bytes:
    """A vocabulary file as bytes: read on the driver and broadcast, so that executors need no such file."""
    with open(path, "rb") as f:
        return f.read()


def kth_largest(df: DataFrame, col: str, k: int) -> float | None:
    """The k-th largest value of a double column (None when k is 0 or no such row), without a global sort.

    Each round counts rows in 1,024 equal bins of the interval that still holds the value. Nulls and NaN are left out.
    """
    df = df.where(F.col(col).isNotNull() & ~F.isnan(col)).select(F.col(col).alias("v"))
    n, lo, hi = df.agg(F.count("*"), F.min("v"), F.max("v")).first()
    if k <= 0 or n == 0:
        return None
    if k >= n:
        return lo
    bins = 1024
    while lo < hi:
        step = (hi - lo) / bins
        if step <= 0 or lo + step == lo:
            return lo
        part = df.where((F.col("v") >= lo) & (F.col("v") <= hi))
        rows = part.groupBy(F.least(F.floor((F.col("v") - lo) / F.lit(step)), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r["b"]):
            if k <= r["n"]:
                lo, hi = r["lo"], r["hi"]
                break
            k -= r["n"]
        if k == 1:
            return hi
    return lo
