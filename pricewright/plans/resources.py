"""Response shapes: nested rows and the parameters of a request."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import core
from ..sources.retail import Retail


def _brand() -> Column:
    return F.struct(F.col("b.id").alias("id"), F.col("b.slug").alias("slug"), F.col("b.name").alias("name"))


def offer_resources(t: Retail, offers: DataFrame) -> DataFrame:
    """Offers (id, product_id, ...) with their product, and in it the chain."""
    product = F.struct(F.col("p.id").alias("id"), F.col("p.name").alias("name"), F.col("p.category").alias("category"), F.col("p.image_url").alias("image_url"), _brand().alias("brand"))
    rows = offers.alias("o").join(t.products.alias("p"), F.col("o.product_id") == F.col("p.id")).join(t.brands.alias("b"), F.col("p.brand_id") == F.col("b.id"))
    return rows.select("o.id", "o.price", "o.original_price", "o.discount_pct", "o.valid_from", "o.valid_to", "o.scraped_at", product.alias("product"))


def offer_with_history(t: Retail, offer: DataFrame, history: DataFrame) -> DataFrame:
    """One offer with its product's snapshots, newest first."""
    shots = history.groupBy("product_id").agg(F.sort_array(F.collect_list(F.struct("scraped_at", "id", "price", "discount_pct")), asc=False).alias("history"))
    return offer.join(shots, "product_id", "left")


def canonical_list(rows: DataFrame) -> DataFrame:
    """Canonicals with their prices in one field."""
    price = F.struct(F.col("min_price").alias("min"), F.col("max_price").alias("max"), F.col("avg_price").alias("avg"))
    return rows.select(F.col("canonical_product_id").alias("id"), "display_name", "image_url", "members_count", "brands_count", price.alias("prices"), "cheapest_brand")


def canonical_detail(comparison: DataFrame) -> DataFrame:
    """One row a canonical: offers cheapest first, prices, savings and the first offer's chain."""
    offer = F.struct("position", "offer_id", "product_id", "brand", "price")
    rows = comparison.groupBy(F.col("canonical_product_id").alias("id")).agg(
        F.array_sort(F.collect_list(offer)).alias("offers"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), F.first("savings").alias("price_savings"), F.min_by("brand", "position").alias("cheapest_brand")
    )
    return rows


def family_summary(rows: DataFrame) -> DataFrame:
    price = F.struct(F.col("min_price").alias("min"), F.col("max_price").alias("max"), F.col("avg_price").alias("avg"))
    return rows.select("family_key", "manufacturer_brand", "category", "size_value", "size_unit", "pack_count", "variants_count", "brands_count", price.alias("prices"), "cheapest_brand", "image_url")


def family_detail(t: Retail, key: str, valid_on) -> DataFrame:
    """One row: the family's facts and totals, and its variants with their products and cheapest chain."""
    from . import families

    whole = families.family_detail(t, key, valid_on)
    parts = families.parse_key(key)
    facts = families.members(t)
    for name, value in parts.items():
        facts = facts.where(F.col(name) == F.lit(value).cast("decimal(10,3)") if name == "size_value" else F.col(name) == F.lit(value))
    facts = facts.groupBy(*families.FAMILY).agg(F.max("category").alias("category"), F.min_by("image_url", F.when(F.coalesce(F.length("image_url"), F.lit(0)) > 0, F.col("id"))).alias("image_url"))
    facts = facts.withColumns({"display_name": families.display_name(), "family_key": F.lit(key), "size_value": F.col("size_value").cast("double")})
    first = lambda v: F.try_element_at(F.filter(v["products"], lambda p: p["price"].isNotNull()), F.lit(1))["brand"]
    variants = F.transform("variants", lambda v: F.struct(v["variant"].alias("variant_descriptor"), v["min_price"].alias("min_price"), v["max_price"].alias("max_price"), first(v).alias("cheapest_brand"), v["products"].alias("products")))
    return facts.join(whole, "family_key").withColumn("variants", variants)


def run_resources(runs: DataFrame) -> DataFrame:
    """Crawl runs as they are shown; counts that were never stated are 0, times are in ISO 8601."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX").alias(c)
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    return runs.select("id", F.col("brand_id").cast("long").alias("brand_id"), "status", iso("started_at"), iso("finished_at"), count("offers_found"), count("offers_persisted"), "error_message", "triggered_by")


def bulk_result(counts: DataFrame) -> DataFrame:
    """What an ingest answers."""
    return counts.select(F.col("offers_persisted").alias("persisted"), "products_created", "products_updated")


def savings(rows: DataFrame) -> DataFrame:
    """Prices with what the cheapest saves, in money and percent of the highest."""
    from ..functions.numbers import savings as amount

    money, percent = amount(F.col("min_price"), F.col("max_price"))
    return rows.withColumns({"saved": money, "saved_pct": percent})


@dataclass(frozen=True)
class OfferQuery:
    brand: tuple[str, ...] = ()
    category: str | None = None
    min_discount: int | None = None
    has_discount: bool = False
    q: str | None = None
    sort: str = "discount_pct"
    dir: str = "desc"
    page: int = 1

    def params(self) -> dict:
        """What the feed takes."""
        return {"brand": ",".join(self.brand) or None, "category": self.category, "min_discount": self.min_discount, "has_discount": self.has_discount or None, "q": self.q, "sort": self.sort, "dir": self.dir, "page": self.page}


def parse_query(given: Mapping[str, str | list[str] | None]) -> OfferQuery:
    """A query from address parameters, which never fails: of many values the first, numbers within bounds, and what makes no sense is the default."""

    def first(name):
        value = given.get(name)
        value = value[0] if isinstance(value, list) and value else value
        return value.strip() if isinstance(value, str) and value.strip() else None

    def number(name, lo, hi):
        value = first(name)
        return min(max(int(value), lo), hi) if value and value.lstrip("-").isdigit() else None

    def one_of(name, allowed, default):
        return first(name) if first(name) in allowed else default

    from .offers import SORTS

    return OfferQuery(
        tuple(core.csv_list(first("brand"))), first("category"), number("min_discount", 0, 100), first("has_discount") in ("1", "true", "yes"), first("q"),
        one_of("sort", SORTS, "discount_pct"), one_of("dir", ("asc", "desc"), "desc"), number("page", 1, 10**6) or 1,
    )
