import datetime
import json
from decimal import Decimal

from pyspark.sql import functions as F

from pricewright.functions import numbers
from pricewright.operators import core, resolve, writes
from pricewright.plans import canonical, families, offers, paging, resources
from pricewright.sources import sinks
from pricewright.sources.retail import star_views

from .test_plans import DAY, shop  # noqa: F401
from .test_resolve_writes import feature, routes


def test_resources(shop):  # noqa: F811
    feed = offers.feed(shop, valid_on=DAY)
    nested = resources.offer_resources(shop, feed).orderBy("id").collect()
    assert nested[0]["product"]["brand"]["slug"] == "b" and nested[1]["id"] == 11
    one = resources.offer_with_history(shop, offers.offer(shop, 10), offers.history(shop, 1)).collect()[0]
    assert [h["id"] for h in one["history"]] == [10, 11]
    assert resources.canonical_list(canonical.canonicals(shop)).collect()[0]["prices"]["min"] == 0.5
    detail = resources.canonical_detail(canonical.comparison(shop, DAY)).collect()[0]
    assert detail["cheapest_brand"] == "c" and [o["position"] for o in detail["offers"]] == [1, 2] and detail["price_savings"] == 2.0
    assert resources.family_summary(families.families(shop, valid_on=DAY)).count() == 2
    assert canonical.top_canonicals(shop).count() == 1


def test_query_parameters():
    q = resources.parse_query({"brand": "a, b", "min_discount": "500", "sort": "odd", "dir": "asc", "page": ["3", "4"], "has_discount": "true", "q": " "})
    assert q == resources.OfferQuery(("a", "b"), None, 100, True, None, "discount_pct", "asc", 3)
    assert resources.parse_query({"page": "-4", "min_discount": "x"}) == resources.OfferQuery()
    assert resources.parse_query({}).params()["brand"] is None


def test_savings(spark):
    rows = resources.savings(spark.createDataFrame([(3.0, 4.0), (0.0, 0.0)], "min_price double, max_price double")).collect()
    assert [(r["saved"], r["saved_pct"]) for r in rows] == [(1.0, 25), (0.0, 0)]


def test_numbered(spark):
    df = spark.range(5000).select((F.col("id") * 7 % 5003).alias("seq"), F.lit(1).alias("x"))
    got = core.numbered(df, "seq", "n", piece=300).orderBy("seq").collect()
    assert [r["n"] for r in got] == list(range(1, 5001))


def test_latest_keeps_one_row(spark):
    rows = [(1, 5, None, "a"), (1, 4, 2, "b"), (2, 1, 3, None)]
    df = spark.createDataFrame(rows, "k int, id long, v int, s string")
    assert sorted(map(tuple, core.latest(df, "k").collect())) == [(1, 5, None, "a"), (2, 1, 3, None)]
    assert sorted(map(tuple, core.latest(df.drop("s"), "k").collect())) == [(1, 5, None), (2, 1, 3)]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_are_what_we_want(spark, sf):
    t = star_views(spark, sf)
    feed = plan_of(offers.matching_offers(t, valid_on=DAY, min_discount=5))
    assert "SortAggregate" not in feed and "HashAggregate" in feed and "PushedFilters" in feed and "Python" not in feed
    scan = next(line for line in feed.splitlines() if "FileScan" in line and "l_orderkey" in line)
    assert "l_tax" not in scan and "l_returnflag" not in scan
    assert "Python" not in plan_of(families.families(t, valid_on=DAY)) and "Python" not in plan_of(canonical.canonicals(t))


def test_counters_and_scans(spark):
    rows = [feature(1, ["a", "b"]), feature(2, ["a", "b", "c"]), feature(3, ["a", "b", "c", "d"]), feature(4, ["zz"])]
    _, pairs, _ = routes(spark, rows)
    got = resolve.joining_pairs(pairs).collect()[0]
    assert (got["joined_by_rule"], got["joined_by_vector"]) == (2, 0)
    listing = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (None, "x", 3), (2, " ", 4), (3, "c", 5)], "product_id long, name string, position int")
    assert sorted((r["product_id"], r["name"]) for r in resolve.collect_features(listing).collect()) == [(1, "a"), (3, "c")]
    pages = spark.createDataFrame([(1, 1, 50), (1, 2, 50), (1, 3, 10), (1, 4, 50)], "crawl_id int, page int, rows int")
    assert sorted(r["page"] for r in paging.until_short_page(pages).collect()) == [1, 2, 3]


def test_backfill(spark):
    df = spark.createDataFrame([(1, "Lacta Γκοφρέτα Φουντούκι 2x31γρ", "Σοκολάτες"), (2, "Pampers No7 38τεμ", None)], "id long, name string, category string")
    got = {r["id"]: r for r in writes.backfill(df).collect()}
    assert (got[1]["manufacturer_brand"], got[1]["category_normalised"], got[1]["size_value"], got[1]["size_unit"], got[1]["pack_count"], got[1]["variant_descriptor"]) == ("lacta", "σοκολατες", Decimal("31.000"), "g", 2, "foyntoyki-gkofreta")
    assert got[2]["size_unit"] == "τεμ"


def test_promo_titles(spark):
    df = spark.createDataFrame([("1+1 δώρο",), ("2 + 1 free",), ("-2,50€ στα 3",), ("€1",), ("x",)], "t string")
    rows = df.select(numbers.multi_buy(F.col("t")).alias("m"), numbers.euro_discount(F.col("t")).alias("e")).collect()
    assert [r["m"] and tuple(r["m"]) for r in rows] == [(1, 1), (2, 1), None, None, None]
    assert [r["e"] and str(r["e"]) for r in rows] == [None, None, "2.50", "1.00", None]


def test_days_left(spark):
    d = datetime.date
    df = spark.createDataFrame([(d(2026, 5, 19),), (d(2026, 5, 20),), (d(2026, 5, 21),), (d(2026, 5, 25),), (d(2026, 6, 20),)], "until date")
    assert [r[0] for r in df.select(numbers.days_left(F.col("until"), DAY)).collect()] == ["expired", "today", "tomorrow", "5 days", "20 Jun"]


def test_sinks(spark, tmp_path):
    at = str(tmp_path / "t")
    sinks.append_offers(spark.range(3), at)
    sinks.append_offers(spark.range(3, 5), at)
    sinks.swap_table(spark.read.parquet(at).where("id > 1"), at)
    assert sorted(r["id"] for r in spark.read.parquet(at).collect()) == [2, 3, 4]
    queue = spark.createDataFrame([(2, 3, 0.9), (1, 5, 0.8)], "a_id long, b_id long, cosine double")
    sinks.write_review_queue(queue, str(tmp_path / "q"))
    assert [r["a_id"] for r in spark.read.json(str(tmp_path / "q")).collect()] == [1, 2]
    payload = spark.createDataFrame([(f"k{i:03d}",) for i in range(450)], "canonical_key string")
    assert [r["count"] for r in sinks.batches(payload).groupBy("batch").count().orderBy("batch").collect()] == [200, 200, 50]
    assert len(json.loads(sinks.dry_run(payload))) == 200 and len(sinks.dry_run(payload, most=10)) == 10
    assert sinks.seed_brands(spark).where("active").count() == 4
