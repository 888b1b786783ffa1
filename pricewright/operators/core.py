"""Filters, collapse and order shared by the query plans. All take and return columns or DataFrames and stay lazy."""

from __future__ import annotations

import tempfile
import time
from collections.abc import Sequence
from functools import reduce
from operator import and_
from urllib.parse import urlencode

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PER_PAGE = 100


def csv_list(value: str | Sequence[str] | None) -> list[str]:
    """Comma-separated names without blanks; nothing left means no filter."""
    parts = value.split(",") if isinstance(value, str) else list(value or ())
    return [p.strip() for p in parts if p.strip()]


def case_variants(value: str) -> list[str]:
    """The value as given, lower, upper and in title case: categories match these and keep their accents."""
    return list(dict.fromkeys([value, value.lower(), value.upper(), value.title()]))


def valid_on(day, start: str = "valid_from", end: str = "valid_to") -> Column:
    """Validity windows with open bounds."""
    d = F.lit(day).cast("date")
    return (F.col(start).isNull() | (F.col(start) <= d)) & (F.col(end).isNull() | (F.col(end) >= d))


def is_discounted() -> Column:
    return F.col("original_price").isNotNull() & (F.col("original_price") > F.col("price"))


def promo_signal() -> Column:
    """Any sign of a promotion: a percentage, a label that isn't blank, or a higher original price."""
    label = F.length(F.trim(F.coalesce(F.col("promo_label"), F.lit("")))) > 0
    pct = F.coalesce(F.col("discount_pct") > 0, F.lit(False))
    return pct | label | F.coalesce(F.col("original_price") > F.col("price"), F.lit(False))


def like(col: str, needle: str) -> Column:
    """Substring match that keeps ``%`` and ``_`` of the needle as wildcards."""
    return F.col(col).like(f"%{needle}%")


#: Types whose aggregation buffers have a fixed width, so that Spark keeps them in a hash map.
FIXED = (T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DoubleType, T.FloatType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


def _fixed_width(kind: T.DataType) -> bool:
    return isinstance(kind, FIXED) or isinstance(kind, T.DecimalType) and kind.precision <= 18


def latest(df: DataFrame, key: str, by: str = "id") -> DataFrame:
    """The row of the highest ``by`` for each key, in one pass with partial aggregation instead of a self-join.

    Columns of fixed width are aggregated one by one, which Spark does by hashing; a struct of the row, which it sorts
    for, is kept for tables with other columns. Both take all columns from one row.
    """
    rest = [c for c in df.columns if c != key]
    if all(_fixed_width(df.schema[c].dataType) for c in rest):
        got = df.groupBy(key).agg(*[F.max(c).alias(c) if c == by else F.max_by(c, by).alias(c) for c in rest])
    else:
        got = df.groupBy(key).agg(F.max_by(F.struct(*rest), by).alias("__row")).select(key, *[F.col(f"__row.{c}").alias(c) for c in rest])
    return got.select(*df.columns)


#: Rows of one piece when rows are numbered.
PIECE = 1_000_000


def numbered(df: DataFrame, seq: str, name: str, ties: Sequence[str] = (), piece: int = PIECE) -> DataFrame:
    """Rows numbered from 1 in the order of the whole number ``seq`` (and ``ties``), without one task for all rows.

    ``seq`` is cut into ranges; rows are ranked in their range, and the sizes of the ranges, one row each, are summed.
    """
    df = df.withColumn("__range", F.floor(F.col(seq) / piece))
    sizes = df.groupBy("__range").agg(F.count("*").alias("__size"))
    before = F.sum("__size").over(Window.orderBy("__range")) - F.col("__size")
    sizes = sizes.select(F.col("__range").alias("__r"), before.alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__range").orderBy(seq, *ties))
    rows = df.withColumn("__rank", rank).join(sizes, F.col("__range").eqNullSafe(F.col("__r")))
    return rows.withColumn(name, F.col("__before") + F.col("__rank")).drop("__range", "__r", "__before", "__rank")


def cut(df: DataFrame) -> DataFrame:
    """The rows as a checkpoint in the folder that ``spark.checkpoint.dir`` names, so that rounds don't pile up in the plan and survive a lost executor."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        at = spark.conf.get("spark.checkpoint.dir", None)
        if not at and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        context.setCheckpointDir(at or "file://" + tempfile.mkdtemp(prefix="pricewright-"))
    return df.checkpoint()


def check_page(page: int, per_page: int) -> None:
    if page < 1:
        raise ValueError("page starts at 1")
    if not 1 <= per_page <= MAX_PER_PAGE:
        raise ValueError(f"per_page is 1 to {MAX_PER_PAGE}")


def page_of(df: DataFrame, order: Sequence[Column], page: int = 1, per_page: int = 50) -> DataFrame:
    """One page of the order; Spark keeps the top ``page * per_page`` rows of each task, not a full sort."""
    check_page(page, per_page)
    df = df.orderBy(*order)
    return (df.offset((page - 1) * per_page) if page > 1 else df).limit(per_page)


def choose(name: str, value: str, allowed: Sequence[str]) -> str:
    if value not in allowed:
        raise ValueError(f"{name} is one of {', '.join(allowed)}")
    return value


def directed(col, dir: str, nulls_last: bool = False) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    choose("dir", dir, ("asc", "desc"))
    if nulls_last:
        return c.asc_nulls_last() if dir == "asc" else c.desc_nulls_last()
    return c.asc() if dir == "asc" else c.desc()


def unknown_keys(given: Column, allowed: Sequence[str]) -> Column:
    """The keys of a map that aren't allowed, in order of the alphabet; none for a null map."""
    return F.array_sort(F.array_except(F.coalesce(F.map_keys(given), F.array().cast("array<string>")), F.array(*map(F.lit, allowed)).cast("array<string>")))


def check_params(given: dict, allowed: Sequence[str]) -> None:
    """Unknown parameters are refused."""
    if unknown := sorted(set(given) - set(allowed)):
        raise ValueError(f"unknown parameters: {', '.join(unknown)}")


def envelope(df: DataFrame, page: int, per_page: int) -> dict:
    """The page's total and last page; two actions, the count and the slice, as any paginator needs."""
    total = df.count()
    return {"total": total, "last_page": max(1, -(-total // per_page)), "current_page": page, "per_page": per_page}


def page_links(path: str, found: dict, params: dict | None = None) -> dict:
    """Addresses of the first, last, previous, next and this page; parameters without a value are left out."""

    def at(n: int) -> str:
        return f"{path}?{urlencode({**{k: v for k, v in (params or {}).items() if v is not None}, 'page': n})}"

    here, last = found["current_page"], found["last_page"]
    return {"self": at(here), "first": at(1), "last": at(last), "prev": at(here - 1) if here > 1 else None, "next": at(here + 1) if here < last else None}


def in_tuples(df: DataFrame, tuples: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows whose columns equal those of any tuple, null as a value like any other; each row once."""
    keys = tuples.select(*[F.col(c).alias(f"__{c}") for c in columns]).distinct()
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns])
    return df.join(keys, same, "left_semi")


def batch_errors(size: Column, most: int = 500) -> Column:
    """What is wrong with the number of items that come at once; null if nothing is."""
    return F.when(F.coalesce(size, F.lit(0)) < 1, "no items").when(size > most, f"more than {most} items")


class Remembered:
    """Rows of a small result, kept for so many seconds; a new table of a crawl shows after that."""

    def __init__(self, make, seconds: float = 3600, most: int = 100_000, clock=time.monotonic):
        self.make, self.seconds, self.most, self.clock = make, seconds, most, clock
        self.rows, self.until = None, None

    def get(self) -> list:
        if self.until is None or self.clock() >= self.until:
            rows = self.make().limit(self.most + 1).collect()
            if len(rows) > self.most:
                raise ValueError(f"more than {self.most} rows to remember")
            self.rows, self.until = rows, self.clock() + self.seconds
        return self.rows
