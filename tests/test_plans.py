"""Where the queries differ on purpose, on small tables."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricewright.operators import core
from pricewright.plans import canonical, families, offers, paging
from pricewright.sources.retail import Retail

DAY = "2026-05-20"
D = datetime.date


@pytest.fixture()
def shop(spark):
    brands = spark.createDataFrame([(1, "A", "a", True), (2, "B", "b", True), (3, "C", "c", False)], "id long, name string, slug string, active boolean")
    fam = ("lacta", "choc", Decimal("31.000"), "g", 1)
    products = spark.createDataFrame(
        [(1, 1, "Lacta x", "lacta x", "Choc", *fam, "x", 7, "i1"), (2, 2, "Lacta y", "lacta y", "Choc", *fam, "y", 7, ""), (3, 3, "Lacta z", "lacta z", "Choc", *fam, "z", 7, "i3"),
         (4, 1, "Other", "other", None, "lacta", None, Decimal("31.000"), "g", 1, None, None, None), (5, 2, "Other 2", "other 2", None, "lacta", None, Decimal("31.000"), "g", 1, "", None, None)],
        "id long, brand_id long, name string, normalized_name string, category string, manufacturer_brand string, category_normalised string, size_value decimal(10,3), size_unit string, pack_count int, variant_descriptor string, canonical_product_id long, image_url string",
    )
    t = datetime.datetime
    rows = [
        (10, 1, "2.00", "3.00", 33, D(2026, 5, 1), D(2026, 6, 1), t(2026, 5, 3)),
        (11, 1, "2.50", None, None, None, None, t(2026, 5, 1)),
        (12, 2, "2.50", None, None, D(2026, 5, 1), D(2026, 5, 10), t(2026, 5, 4)),
        (9, 2, "1.00", "2.00", 50, None, None, t(2026, 5, 2)),
        (20, 3, "0.50", "1.00", 50, None, None, t(2026, 5, 2)),
    ]
    rows = [(i, p, Decimal(a), b and Decimal(b), c, f, u, s) for i, p, a, b, c, f, u, s in rows]
    offers_ = spark.createDataFrame(rows, "id long, product_id long, price decimal(10,2), original_price decimal(10,2), discount_pct int, valid_from date, valid_to date, scraped_at timestamp")
    return Retail(brands, products, offers_, None)


def ids(df, col="id"):
    return [r[col] for r in df.collect()]


def test_feed_filters_before_it_collapses(shop):
    assert ids(offers.feed(shop, valid_on=DAY)) == [9, 11]
    assert ids(offers.feed(shop, valid_on=DAY, min_discount=0)) == [9, 10]
    assert ids(offers.feed(shop, valid_on=DAY, has_discount=True)) == [9, 10]
    assert ids(offers.feed(shop, valid_on=DAY, brand="b, ,")) == [9]
    assert ids(offers.feed(shop, valid_on=DAY, brand=" , ")) == [9, 11]
    assert ids(offers.feed(shop, valid_on=DAY, category="choc")) == [9, 11]
    assert ids(offers.feed(shop, valid_on=DAY, category="chocs")) == []
    assert ids(offers.brand_feed(shop, "c", valid_on=DAY)) == []
    assert ids(offers.feed(shop, valid_on=DAY, page=2, per_page=1)) == [11]


def test_parameters_are_checked(shop):
    for bad in ({"sort": "name"}, {"dir": "up"}, {"page": 0}, {"per_page": 101}):
        with pytest.raises(ValueError):
            offers.feed(shop, valid_on=DAY, **bad)
    with pytest.raises(ValueError):
        offers.search(shop, " ", valid_on=DAY)
    with pytest.raises(ValueError):
        core.check_params({"q": 1, "zz": 2}, ["q"])


def test_single_offers(shop):
    assert ids(offers.offer(shop, 20)) == [20]
    assert ids(offers.history(shop, 1)) == [10, 11]
    assert {r["product_id"]: r["id"] for r in offers.latest_snapshot(shop.offers).collect()} == {1: 10, 2: 12, 3: 20}


def test_families_take_latest_before_validity(shop):
    rows = {r["category_normalised"]: r for r in families.families(shop, valid_on=DAY).collect()}
    choc = rows["choc"]
    assert (choc["variants_count"], choc["brands_count"], choc["min_price"], choc["cheapest_brand"], choc["image_url"]) == (2, 2, 2.5, "a", "i1")
    assert rows[None]["variants_count"] == 2 and rows[None]["min_price"] is None


def test_family_gate_keeps_counts_and_q_shrinks_them(shop):
    gated = families.families(shop, valid_on=DAY, brand="b").collect()
    assert [(r["category_normalised"], r["variants_count"]) for r in gated] == [("choc", 2)]
    assert [r["variants_count"] for r in families.families(shop, valid_on=DAY, q="y", min_variants=1).collect()] == [1]


def test_family_detail(shop):
    rows = families.family_variants(shop, "lacta|choc|31|g|1", DAY).collect()
    assert [(r["variant"], r["product_id"], r["price"]) for r in rows] == [("x", 1, 2.5), ("y", 2, None)]
    whole = families.family_detail(shop, "lacta|choc|31|g|1", DAY).collect()[0]
    assert whole["variants_count"] == 2 and len(whole["variants"]) == 2
    for bad in ("a|b|c", "lacta||31|g|1", "lacta|choc|x|g|1"):
        with pytest.raises(ValueError):
            families.parse_key(bad)


def test_family_names(spark):
    df = spark.createDataFrame([("coca-cola", "soft drink", Decimal("1.500"), "l", 6)], "manufacturer_brand string, category_normalised string, size_value decimal(10,3), size_unit string, pack_count int")
    got = df.select(families.display_name().alias("n"), families.family_key().alias("k")).collect()[0]
    assert got["n"] == "Coca Cola Soft Drink 6×1.5l" and got["k"] == "coca-cola|soft drink|1.5|l|6"


def test_canonical_prices_ignore_validity_and_detail_does_not(shop):
    row = canonical.canonicals(shop).collect()[0]
    assert (row["members_count"], row["brands_count"], row["min_price"], row["max_price"], row["avg_price"], row["cheapest_brand"]) == (3, 3, 0.5, 2.5, 1.83, "c")
    detail = canonical.comparison(shop, DAY, 7).collect()
    assert [(r["position"], r["brand"], r["price"], r["savings"]) for r in detail] == [(1, "c", 0.5, 2.0), (2, "a", 2.5, 2.0)]
    assert canonical.canonicals(shop, min_brands=4).count() == 0


def test_cheapest_of_a_tie_is_the_newest(spark, shop):
    tied = shop.offers.where("product_id <> 3").withColumn("price", F.lit(1).cast("decimal(10,2)"))
    row = canonical.canonicals(Retail(shop.brands, shop.products, tied, None)).collect()[0]
    assert row["cheapest_brand"] == "b"


def test_pages(spark):
    html = spark.createDataFrame([('<nav data-mkey="page-2"></nav><i data-mkey="page-11">',), ("<p>",)], "h string")
    assert [r[0] for r in html.select(paging.total_pages(F.col("h"))).collect()] == [11, None]
    pages = spark.createDataFrame([(1, p, 0 if 3 <= p <= 5 or p == 8 else 4) for p in range(1, 10)], "crawl_id int, page int, emitted int")
    assert sorted(ids(paging.pages_read(pages, stop_after=3), "page")) == [1, 2, 3, 4, 5]
    assert sorted(ids(paging.pages_read(pages, stop_after=4, cap=7), "page")) == [1, 2, 3, 4, 5, 6, 7]


def test_empty_tables(shop):
    none = Retail(shop.brands.limit(0), shop.products.limit(0), shop.offers.limit(0), None)
    assert offers.feed(none, valid_on=DAY).count() == 0
    assert families.families(none, valid_on=DAY).count() == 0
    assert canonical.canonicals(none).count() == 0


def test_links_of_pages_and_remembered_rows(spark):
    found = {"total": 120, "last_page": 3, "current_page": 2, "per_page": 50}
    got = core.page_links("/offers", found, {"q": "a b", "brand": None})
    assert got == {"self": "/offers?q=a+b&page=2", "first": "/offers?q=a+b&page=1", "last": "/offers?q=a+b&page=3", "prev": "/offers?q=a+b&page=1", "next": "/offers?q=a+b&page=3"}
    assert core.page_links("/x", found | {"current_page": 3})["next"] is None
    now, made = [0.0], []

    def make():
        made.append(1)
        return spark.range(len(made))

    kept = core.Remembered(make, seconds=10, clock=lambda: now[0])
    assert len(kept.get()) == 1 and len(kept.get()) == 1
    now[0] = 10.0
    assert len(kept.get()) == 2 and len(made) == 2
    with pytest.raises(ValueError):
        core.Remembered(lambda: spark.range(5), most=4).get()
