"""Product families: products of one maker, category, size, unit and pack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import mean_price
from ..functions.text import normalize_literal
from ..operators import core
from ..schema import FAMILY
from ..sources.retail import Retail

COUNT_SORTS, PRICE_SORTS = ("variants_count", "brands_count"), ("min_price", "max_price", "avg_price")
NO_VARIANT = "—"


def size_text(value: Column) -> Column:
    """A whole number, or up to three decimals without trailing zeros."""
    text = value.cast("decimal(10,3)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")


def family_key() -> Column:
    """The five parts joined by bars. A null category leaves its part empty."""
    parts = [F.col("manufacturer_brand"), F.coalesce("category_normalised", F.lit("")), size_text(F.col("size_value")), F.col("size_unit"), F.col("pack_count").cast("string")]
    return F.concat_ws("|", *parts)


def parse_key(key: str) -> dict:
    """The parts of a key; anything but five parts, an empty one of the first four, or numbers that aren't are refused."""
    parts = key.split("|")
    if len(parts) != 5 or not all(parts[:4]):
        raise ValueError("not a family key")
    try:
        return dict(zip(FAMILY, [parts[0], parts[1], float(parts[2]), parts[3], int(parts[4])], strict=True))
    except ValueError:
        raise ValueError("not a family key") from None


def display_name() -> Column:
    """Maker, category and size in words, with the count of a pack before the size."""
    size = F.concat(size_text(F.col("size_value")), F.col("size_unit"))
    packed = F.when(F.col("pack_count") > 1, F.concat(F.col("pack_count").cast("string"), F.lit("×"), size)).otherwise(size)
    return F.concat_ws(" ", F.initcap(F.translate("manufacturer_brand", "-", " ")), F.initcap(F.coalesce("category_normalised", F.lit(""))), packed)


def members(t: Retail) -> DataFrame:
    """Products of active chains that belong to a family."""
    active = t.brands.where("active").select(F.col("id").alias("brand_id"), F.col("slug").alias("brand"))
    whole = "manufacturer_brand is not null and size_value is not null and size_unit is not null"
    return t.products.where(whole).join(active, "brand_id")


def priced(members: DataFrame, offers: DataFrame, valid_on) -> DataFrame:
    """Members with their offer: the latest of all, and only then only if it is valid, so an expired newest hides older ones."""
    now = core.latest(offers.select("id", "product_id", "price", "valid_from", "valid_to"), "product_id").where(core.valid_on(valid_on))
    now = now.select(F.col("product_id").alias("id"), F.col("id").alias("offer_id"), F.col("price").cast("double").alias("price"))
    return members.join(now, "id", "left")


def families(t: Retail, *, valid_on, q=None, brand=None, manufacturer=None, category=None, min_variants=2, min_brands=1) -> DataFrame:
    """Every family that passes the filters, with counts and prices.

    ``q`` holds for products, so counts shrink to those that match; ``brand`` only asks that the family has a product
    of one of the chains, by plain equality, so families without a category never pass it. Prices are of all members,
    and the cheapest chain of equal prices is that of the lowest product id. One pass over the members gives all.
    """
    rows = members(t)
    if manufacturer:
        rows = rows.where(F.col("manufacturer_brand") == manufacturer.lower())
    if category:
        rows = rows.where(F.col("category_normalised") == normalize_literal(category))
    hit = F.lit(True)
    if q:
        needle = normalize_literal(q)
        hit = F.coalesce(core.like("manufacturer_brand", needle) | core.like("category_normalised", needle) | core.like("normalized_name", needle), F.lit(False))
    if slugs := core.csv_list(brand):
        gate = members(t).where(F.col("brand").isin(slugs)).select(*FAMILY).distinct()
        rows = rows.join(gate, list(FAMILY), "left_semi")
    rows = priced(rows, t.offers, valid_on).withColumn("__hit", hit)
    has = F.col("price").isNotNull()
    got = rows.groupBy(*FAMILY).agg(
        F.max(F.when(F.col("__hit"), F.col("category"))).alias("category"),
        F.count_if("__hit").alias("variants_count"),
        F.count_distinct(F.when(F.col("__hit"), F.col("brand_id"))).alias("brands_count"),
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        mean_price(F.col("price")).alias("avg_price"),
        F.min_by(F.when(has, F.col("brand")), F.when(has, F.struct("price", "id"))).alias("cheapest_brand"),
        F.min_by("image_url", F.when(F.coalesce(F.length("image_url"), F.lit(0)) > 0, F.col("id"))).alias("image_url"),
    )
    return got.where((F.col("variants_count") >= min_variants) & (F.col("brands_count") >= min_brands)).withColumn("family_key", family_key())


def family_page(t: Retail, *, sort="variants_count", dir="desc", page=1, per_page=50, **filters) -> DataFrame:
    """A page of families. Prices sort with nulls last either way; the key decides what is left equal."""
    core.choose("sort", sort, COUNT_SORTS + PRICE_SORTS)
    other = {"variants_count": "brands_count", "brands_count": "variants_count"}
    order = [core.directed(sort, dir), F.col(other[sort]).desc()] if sort in other else [core.directed(sort, dir, True), F.col("variants_count").desc()]
    return core.page_of(families(t, **filters), [*order, F.col("family_key")], page, per_page)


def family_variants(t: Retail, key: str, valid_on) -> DataFrame:
    """One row a product of the family, in the order of the detail: variants by least price, products by price, nulls last.

    Variant columns repeat on each of its products. A key with an empty part has no detail.
    """
    parts = parse_key(key)
    rows = members(t)
    for name, value in parts.items():
        rows = rows.where(F.col(name) == F.lit(value).cast("decimal(10,3)") if name == "size_value" else F.col(name) == F.lit(value))
    variant = F.when(F.coalesce("variant_descriptor", F.lit("")) == "", F.lit(NO_VARIANT)).otherwise(F.col("variant_descriptor"))
    rows = priced(rows, t.offers, valid_on).withColumn("variant", variant)
    by = rows.groupBy("variant").agg(
        F.min("price").alias("min_price"),
        F.max("price").alias("max_price"),
        F.array_sort(F.collect_list(F.struct(F.col("price").isNull().alias("none"), "price", "id", "brand", "offer_id"))).alias("products"),
    )
    return by.select("variant", "min_price", "max_price", F.posexplode("products").alias("position", "p")).select(
        "variant", "min_price", "max_price", "position", F.col("p.id").alias("product_id"), F.col("p.brand").alias("brand"), F.col("p.price").alias("price"), F.col("p.offer_id").alias("offer_id")
    ).orderBy(F.col("min_price").asc_nulls_last(), "variant", "position")


def family_detail(t: Retail, key: str, valid_on) -> DataFrame:
    """The family as one row: totals, and variants with their products nested."""
    rows = family_variants(t, key, valid_on)
    product = F.struct("position", "product_id", "brand", "price", "offer_id")
    nested = rows.groupBy("variant", "min_price", "max_price").agg(F.array_sort(F.collect_list(product)).alias("products"))
    totals = rows.agg(F.count("*").alias("variants_count"), F.count_distinct("brand").alias("brands_count"), F.min("price").alias("min_price"), F.max("price").alias("max_price"), mean_price(F.col("price")).alias("avg_price"))
    whole = nested.agg(F.array_sort(F.collect_list(F.struct(F.col("min_price").isNull().alias("none"), "min_price", "variant", "max_price", "products"))).alias("variants"))
    return totals.withColumn("family_key", F.lit(key)).join(whole)


def distinct_families(products: DataFrame) -> DataFrame:
    """How many families there are, those without a category left out: a null part makes the whole key null."""
    key = F.concat("manufacturer_brand", F.lit("|"), "category_normalised", F.lit("|"), F.col("size_value").cast("string"), F.lit("|"), "size_unit", F.lit("|"), F.col("pack_count").cast("string"))
    return products.agg(F.count_distinct(key).alias("families"))
