"""Canonical products: equal products of several chains, compared by price."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import mean_price
from ..operators import core
from ..sources.retail import Retail

SORTS = {"brands_count": "members_count", "members_count": "brands_count"}


def membership(products: DataFrame) -> DataFrame:
    """Members, chains, a name and an image of each canonical: those of the lowest product id that has one."""
    some = lambda c: F.when(F.coalesce(F.length(c), F.lit(0)) > 0, F.col("id"))
    rows = products.where("canonical_product_id is not null")
    return rows.groupBy("canonical_product_id").agg(
        F.count("*").alias("members_count"),
        F.count_distinct("brand_id").alias("brands_count"),
        F.min_by("name", some("name")).alias("display_name"),
        F.min_by("image_url", some("image_url")).alias("image_url"),
    )


def pricing(t: Retail) -> DataFrame:
    """Prices over the latest offer of each member, valid or not; of equal lowest prices the highest offer id's chain.

    One aggregation gives the lowest, highest and mean price and the cheapest chain.
    """
    now = core.latest(t.offers.select("id", "product_id", "price"), "product_id").where("price is not null")
    member = t.products.where("canonical_product_id is not null").select(F.col("id").alias("product_id"), "canonical_product_id", "brand_id")
    rows = now.join(member, "product_id").join(t.brands.select(F.col("id").alias("brand_id"), F.col("slug").alias("brand")), "brand_id")
    price = F.col("price").cast("double")
    return rows.groupBy("canonical_product_id").agg(
        F.min(price).alias("min_price"),
        F.max(price).alias("max_price"),
        mean_price(price).alias("avg_price"),
        F.min_by("brand", F.struct(price, -F.col("id"))).alias("cheapest_brand"),
    )


def canonicals(t: Retail, *, q=None, brand=None, category=None, min_brands=2) -> DataFrame:
    """Canonicals of at least so many chains; ``brand`` asks for a member of one of the chains, active or not."""
    rows = membership(t.products).where(F.col("brands_count") >= min_brands)
    if q:
        rows = rows.where(F.col("display_name").ilike(f"%{q}%"))
    if category:
        there = t.products.where(F.col("category").isin(core.case_variants(category))).select("canonical_product_id")
        rows = rows.join(there, "canonical_product_id", "left_semi")
    if slugs := [s for s in core.csv_list(brand) if s != "0"]:
        chains = t.brands.where(F.col("slug").isin(slugs)).select(F.col("id").alias("brand_id"))
        there = t.products.join(chains, "brand_id", "left_semi").select("canonical_product_id")
        rows = rows.join(there, "canonical_product_id", "left_semi")
    return rows.join(pricing(t), "canonical_product_id", "left")


def canonical_page(t: Retail, *, sort="brands_count", dir="desc", page=1, per_page=50, **filters) -> DataFrame:
    """Both counts sort the same way, then the id upwards."""
    core.choose("sort", sort, tuple(SORTS))
    order = [core.directed(sort, dir), core.directed(SORTS[sort], dir), F.col("canonical_product_id").asc()]
    return core.page_of(canonicals(t, **filters), order, page, per_page)


def top_canonicals(t: Retail, rows: int = 100, min_brands: int = 2) -> DataFrame:
    """The canonicals that a site map lists."""
    return canonical_page(t, per_page=rows, min_brands=min_brands).select("canonical_product_id")


def comparison(t: Retail, valid_on, canonical_id: int | None = None) -> DataFrame:
    """The offers of a canonical (or of all), cheapest first: each member's latest offer if it is valid.

    ``position`` starts at 1 in each canonical; ``savings`` is the highest less the lowest price.
    """
    member = t.products.where("canonical_product_id is not null")
    if canonical_id is not None:
        member = member.where(F.col("canonical_product_id") == canonical_id)
    member = member.select(F.col("id").alias("product_id"), "canonical_product_id", "brand_id")
    now = core.latest(t.offers.select("id", "product_id", "price", "valid_from", "valid_to"), "product_id").where(core.valid_on(valid_on))
    rows = now.join(member, "product_id").join(t.brands.select(F.col("id").alias("brand_id"), F.col("slug").alias("brand")), "brand_id")
    price = F.col("price").cast("double")
    spread = rows.groupBy("canonical_product_id").agg(F.round(F.max(price) - F.min(price), 2).alias("savings"))
    place = F.row_number().over(Window.partitionBy("canonical_product_id").orderBy(price.asc_nulls_last(), "id"))
    return rows.join(spread, "canonical_product_id").withColumn("position", place).select("canonical_product_id", "savings", "position", F.col("id").alias("offer_id"), "product_id", "brand", price.alias("price"))
