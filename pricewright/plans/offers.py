"""The offers feed, one offer, and its history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_literal
from ..operators import core
from ..sources.retail import Retail

SORTS = ("discount_pct", "price", "scraped_at")
HISTORY_ROWS = 200
FEED_COLUMNS = ("id", "product_id", "brand", "name", "category", "price", "original_price", "discount_pct", "valid_from", "valid_to", "scraped_at")


def matching_offers(t: Retail, *, brand=None, category=None, min_discount=None, has_discount=None, valid_on, q=None) -> DataFrame:
    """The latest of each product's offers that match, of active chains.

    Offers are filtered first and collapsed then, so an older offer that matches can stand for its product. Filters on
    product and chain hold for all offers of a product alike, so they join the collapsed rows.
    """
    offers = t.offers.where(core.valid_on(valid_on))
    if min_discount is not None:
        offers = offers.where(F.col("discount_pct") >= min_discount)
    if has_discount:
        offers = offers.where(core.is_discounted())
    products, brands = t.products, t.brands.where("active")
    if slugs := core.csv_list(brand):
        brands = brands.where(F.col("slug").isin(slugs))
    if category:
        products = products.where(F.col("category").isin(core.case_variants(category)))
    if q:
        products = products.where(core.like("normalized_name", normalize_literal(q)))
    offers = core.latest(offers.select("id", "product_id", "price", "original_price", "discount_pct", "valid_from", "valid_to", "scraped_at"), "product_id")
    products = products.select(F.col("id").alias("product_id"), "brand_id", "name", "category")
    brands = brands.select(F.col("id").alias("brand_id"), F.col("slug").alias("brand"))
    return offers.join(products, "product_id").join(brands, "brand_id").select(*FEED_COLUMNS)


def feed(t: Retail, *, valid_on, sort="discount_pct", dir="desc", page=1, per_page=50, **filters) -> DataFrame:
    """One page of the feed; without a discount an offer sorts as 0. Ties: newest id first."""
    core.choose("sort", sort, SORTS)
    key = F.coalesce(F.col("discount_pct"), F.lit(0)) if sort == "discount_pct" else F.col(sort)
    return core.page_of(matching_offers(t, valid_on=valid_on, **filters), [core.directed(key, dir), F.col("id").desc()], page, per_page)


def search(t: Retail, q: str, **params) -> DataFrame:
    if not (q or "").strip():
        raise ValueError("q is required")
    return feed(t, q=q, **params)


def brand_feed(t: Retail, slug: str, **params) -> DataFrame:
    """The feed of one chain; a chain that isn't active has none."""
    return feed(t, **{**params, "brand": slug})


def offer(t: Retail, offer_id: int) -> DataFrame:
    """One offer with its product and chain, whether or not it is valid or the chain active."""
    if offer_id <= 0:
        raise ValueError("ids are positive")
    brand = t.brands.select(F.col("id").alias("brand_id"), F.struct(F.col("id"), F.col("slug"), F.col("name")).alias("brand"))
    product = t.products.select(F.col("id").alias("product_id"), "brand_id", F.struct("id", "name", "category", "image_url").alias("product"))
    return t.offers.where(F.col("id") == offer_id).join(product, "product_id").join(brand, "brand_id").drop("brand_id")


def history(t: Retail, product_id: int) -> DataFrame:
    """A product's snapshots, newest scrape first, at most 200."""
    rows = t.offers.where(F.col("product_id") == product_id).select("id", "product_id", "price", "discount_pct", "scraped_at")
    return rows.orderBy(F.desc("scraped_at"), F.desc("id")).limit(HISTORY_ROWS)


def latest_snapshot(rows: DataFrame, key: str = "product_id", at: str = "scraped_at", id: str = "id") -> DataFrame:
    """Each product's newest snapshot: by time of the scrape, then id."""
    return rows.groupBy(key).agg(F.max_by(id, F.struct(at, id)).alias(id))


def history_extent(rows: DataFrame, key: str = "product_id") -> DataFrame:
    """History rows with their place, and the least and greatest price of the product; every lowest price is marked."""
    by = Window.partitionBy(key)
    order = by.orderBy("scraped_at", "id")
    rows = rows.withColumns({"position": F.row_number().over(order), "min_price": F.min("price").over(by), "max_price": F.max("price").over(by)})
    return rows.withColumn("cheapest", F.col("price") == F.col("min_price"))


def label_histogram(offers: DataFrame, rows: int = 20) -> DataFrame:
    """The commonest promotion labels, offers without one too, with their lowest price."""
    by = offers.groupBy(F.col("promo_label").alias("label")).agg(F.count("*").alias("offers"), F.min(F.col("price").cast("double")).alias("least"))
    return by.orderBy(F.desc("offers"), F.col("label").asc_nulls_first()).limit(rows)


def active_brands(t: Retail) -> DataFrame:
    return t.brands.where("active").select("id", "name", "slug").orderBy("name")


def categories(t: Retail) -> DataFrame:
    """Distinct categories of active chains' products, without null and empty ones."""
    active = t.brands.where("active").select(F.col("id").alias("brand_id"))
    return t.products.join(active, "brand_id", "left_semi").where("category is not null and category <> ''").select("category").distinct().orderBy("category")


def absent_brands(t: Retail, canonical_id: int) -> DataFrame:
    """Active chains without a product of this canonical."""
    there = t.products.where(F.col("canonical_product_id") == canonical_id).select(F.col("brand_id").alias("id"))
    return t.brands.where("active").join(there, "id", "left_anti").select("id", "slug")


def brands_with_config(brands: DataFrame, configs: DataFrame) -> DataFrame:
    """Chains by id with how they are crawled; a chain without a configuration has none."""
    config = configs.select(F.col("brand_id").alias("id"), F.struct("strategy", "start_url", "rate_limit_ms", "respect_robots_txt", "cache_ttl_seconds", "schedule_cron").alias("config"))
    return brands.join(config, "id", "left").orderBy("id")


def run_counts(t: Retail) -> DataFrame:
    return t.offers.groupBy("crawl_run_id").agg(F.count("*").alias("offers_persisted"))


def latest_successful_runs(t: Retail) -> DataFrame:
    rows = t.runs.where("status = 'success'")
    return rows.groupBy("brand_id").agg(F.max_by("id", F.struct("finished_at", "id")).alias("run_id"), F.max("finished_at").alias("finished_at"))
