"""Pages of a crawl: how far it has to go, runs of empty pages, and first occurrences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def total_pages(html: Column) -> Column:
    """The highest N of ``data-mkey="page-N"``; null, not 1, if there is none."""
    pages = F.transform(F.regexp_extract_all(html, F.lit(r'data-mkey="page-([0-9]+)"'), F.lit(1)), lambda x: x.try_cast("int"))
    return F.array_max(pages)


def streaks(rows: DataFrame, keys: Sequence[str], order: Sequence[str], flag: str) -> DataFrame:
    """Runs of rows whose flag holds, one after the other in each key: first_id (last column of the order) and length."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    rows = rows.withColumn("__n", n)
    island = F.col("__n") - F.row_number().over(Window.partitionBy(*keys, flag).orderBy("__n"))
    rows = rows.withColumn("__island", island).where(flag)
    return rows.groupBy(*keys, "__island").agg(F.min_by(order[-1], "__n").alias("first_id"), F.count("*").alias("streak")).drop("__island")


def pages_read(pages: DataFrame, crawl: str = "crawl_id", page: str = "page", emitted: str = "emitted", stop_after: int = 8, cap: int | None = None) -> DataFrame:
    """The pages that a crawl gets to: up to the end of the first run of so many empty pages, and the cap."""
    empty = pages.withColumn("__empty", F.col(emitted) == 0)
    runs = streaks(empty, [crawl], [page], "__empty").where(F.col("streak") >= stop_after)
    last = runs.groupBy(crawl).agg((F.min("first_id") + stop_after - 1).alias("__last"))
    rows = pages.join(last, crawl, "left").where(F.col("__last").isNull() | (F.col(page) <= F.col("__last"))).drop("__last")
    return rows.where(F.col(page) <= cap) if cap is not None else rows


def until_short_page(pages: DataFrame, crawl: str = "crawl_id", page: str = "page", rows: str = "rows", full: int = 50, cap: int | None = None) -> DataFrame:
    """The pages of a crawl that stops at the first page with fewer rows than a full one."""
    last = pages.where(F.col(rows) < full).groupBy(crawl).agg(F.min(page).alias("__last"))
    got = pages.join(last, crawl, "left").where(F.col("__last").isNull() | (F.col(page) <= F.col("__last"))).drop("__last")
    return got.where(F.col(page) <= cap) if cap is not None else got


def first_seen(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key by position."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")
