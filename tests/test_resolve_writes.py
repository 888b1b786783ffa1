import datetime
import json
from decimal import Decimal

from pyspark.sql import functions as F

from pricewright.operators import resolve, writes
from pricewright.sources import chains
from pricewright.streaming import ingest

FEATURE = "product_id long, brand_slug string, name string, category string, manufacturer string, size struct<value:double,unit:string>, pack int, variant_tokens array<string>, canonical_key string"


def feature(i, tokens, maker="lacta", size=(31.0, "g"), pack=1, chain=None, key=None):
    return (i, chain or f"c{i}", f"n{'x' * i}", "cat", maker, size, pack, sorted(tokens), key or f"{maker}:{'-'.join(sorted(tokens)) or 'x'}:31g:{pack}")


def routes(spark, rows, vectors=None, config=resolve.MatchConfig()):
    f = spark.createDataFrame(rows, FEATURE)
    v = None if vectors is None else spark.createDataFrame(vectors, "product_id long, vector array<float>")
    pairs = resolve.scored_pairs(f, v, config)
    return f, pairs, {(r["x"], r["y"]): r["route"] for r in pairs.select(F.col("a.product_id").alias("x"), F.col("b.product_id").alias("y"), "route").collect()}


def test_rules(spark):
    rows = [feature(1, ["a", "b"]), feature(2, ["a", "b", "c"]), feature(3, ["q"]), feature(4, []), feature(5, ["a", "x", "y"]), feature(6, ["a"], maker=None), feature(7, ["a"], size=None)]
    _, pairs, got = routes(spark, rows)
    assert got[1, 2] == "rule_merged" and got[1, 3] == "rule_dropped" and got[1, 4] == "rule_dropped" and got[1, 5] == "rule_dropped"
    assert not any(6 in k or 7 in k for k in got)
    sure = {(r["x"], r["y"]): (r["c"], r["s"]) for r in pairs.select(F.col("a.product_id").alias("x"), F.col("b.product_id").alias("y"), F.col("decision.confidence").alias("c"), F.col("decision.same").alias("s")).collect()}
    assert sure[1, 4] == (0.95, False) and sure[1, 3] == (1.0, False) and sure[1, 5] == (0.6, False) and round(sure[1, 2][0], 6) == round(0.9 + 0.1 * 2 / 3, 6)


def test_vectors_route_what_rules_leave_open(spark):
    rows = [feature(1, ["a", "b"]), feature(2, ["a", "x", "y"]), feature(3, ["b", "p", "q"])]
    vec = lambda c: [c, (1 - c * c) ** 0.5]
    _, _, got = routes(spark, rows, [(1, [1.0, 0.0]), (2, vec(0.97)), (3, vec(0.9))])
    assert got[1, 2] == "embedding_merged" and got[1, 3] == "review" and got[2, 3] == "rule_dropped"
    _, pairs, strict = routes(spark, rows, [(1, [1.0, 0.0]), (2, vec(0.96)), (3, vec(0.5))], resolve.CLI)
    assert strict[1, 2] == "review" and strict[1, 3] == "embedding_dropped"
    stats = resolve.pair_statistics(pairs).collect()[0]
    assert stats["pairs_evaluated"] == 3 and stats["pairs_review"] == 1
    assert resolve.review_queue(pairs).collect()[0]["a_id"] == 1


def test_components_and_payload(spark):
    rows = [feature(1, ["a", "b"]), feature(2, ["a", "b", "c"]), feature(3, ["b", "c", "d"]), feature(4, ["zz"])]
    f, pairs, _ = routes(spark, rows)
    grouped = resolve.groups(f, pairs)
    assert {r["product_id"]: r["component"] for r in grouped.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    got = {r["canonical_key"]: r for r in resolve.payloads(grouped).collect()}
    big = got["lacta:a-b-c:31g:1"] if "lacta:a-b-c:31g:1" in got else got["lacta:a-b:31g:1"]
    assert [m["product_id"] for m in big["members"]] == [1, 2, 3] and big["display_name"] == "nxxx" and big["variant_descriptor"] == "A B"
    assert [str(m["confidence"]) for m in big["members"]] == ["1.000", "1.000", "0.850"]
    summary = resolve.group_summary(resolve.payloads(grouped)).collect()[0]
    assert (summary["groups"], summary["singletons"], summary["three_brands"]) == (2, 1, 1)
    assert resolve.payloads(grouped, include_singletons=False).count() == 1


def test_large_blocks_are_left_and_equal_keys_told_apart(spark):
    rows = [feature(i, ["same"]) for i in range(1, 10)]
    f, pairs, got = routes(spark, rows)
    assert got == {}
    keys = sorted(r["group_key"] for r in resolve.groups(f, pairs).collect())
    assert len(set(keys)) == 9 and keys[0] == "lacta:same:31g:1" and keys[1].startswith("lacta:same:31g:1#")


def test_title(spark):
    assert spark.createDataFrame([(["3bit", "παγωτο"],)], "t array<string>").select(resolve.title(F.col("t"))).first()[0] == "3Bit Παγωτο"


ITEM = "external_id string, name string, normalized_name string, brand_id long, price decimal(10,2), original_price decimal(10,2), discount_pct int, promo_label string, promo_type string, currency string, valid_from date, valid_to date, scraped_at timestamp, seq long"


def item(seq, ext, name, brand=1, price="1.00", old=None, pct=None, label="x", kind=None, start=None, end=None):
    return (ext, name, (name or "").lower(), brand, price and Decimal(price), old and Decimal(old), pct, label, kind, "EUR", start, end, datetime.datetime(2026, 5, 1), seq)


def test_validation(spark):
    d = datetime.date
    rows = [item(1, "e", "N"), item(2, "e", "N", label=" "), item(3, "e", "N", start=d(2026, 2, 1), end=d(2026, 1, 1)), item(4, "e", "", price=None), item(5, "e", "N", kind="odd"), item(6, "e", "N", label=None, old="2.00")]
    good, bad = writes.split_offers(spark.createDataFrame(rows, ITEM))
    assert sorted(r["seq"] for r in good.collect()) == [1, 6]
    errors = {r["seq"]: r["errors"] for r in bad.collect()}
    assert errors[2] == ["no sign of a promotion"] and errors[3] == ["valid_to is before valid_from"] and errors[4] == ["name is required", "price is required"] and errors[5] == ["promo_type is unknown"]


def test_resolve_and_merge(spark):
    products = spark.createDataFrame([(1, 1, "e1", "Old", "old"), (2, 1, None, "Plain", "plain"), (3, 1, "e3", "Named", "named")], "id long, brand_id long, external_id string, name string, normalized_name string")
    rows = [item(1, "e1", "New"), item(2, "e9", "Plain"), item(3, "e8", "Named"), item(4, None, "Plain"), item(5, "e8", "Named 2"), item(6, "e1", "Newer"), item(7, "e1", "Else", brand=2)]
    got = writes.resolve_products(products, spark.createDataFrame(rows, ITEM))
    by = {r["seq"]: (r["product_id"], r["created"]) for r in got.collect()}
    assert by == {1: (1, False), 2: (2, False), 3: (4, True), 4: (2, False), 5: (4, False), 6: (1, False), 7: (5, True)}
    merged = {r["id"]: r for r in writes.merge_products(products, got).collect()}
    assert merged[1]["name"] == "Newer" and merged[2]["external_id"] is None and merged[4]["external_id"] == "e8" and merged[4]["name"] == "Named 2" and len(merged) == 5
    counts = writes.ingest_counts(got, products).collect()[0]
    assert (counts["offers_persisted"], counts["products_created"], counts["products_updated"]) == (7, 2, 3)
    offers = spark.createDataFrame([(50, 1, None, Decimal("1.00"), "EUR")], "id long, product_id long, crawl_run_id long, price decimal(10,2), currency string")
    assert sorted((r["id"], r["crawl_run_id"]) for r in writes.new_offers(offers, got, 3).collect()) == [(51 + i, 3) for i in range(7)]


def one_by_one(products, rows):
    """The resolver as it reads: row after row."""
    have = [dict(zip(("id", "brand", "ext", "name"), p, strict=True)) for p in products]
    out = {}
    for seq, brand, ext, name in sorted(rows):
        mine = [p for p in have if p["brand"] == brand]
        hit = next((p for p in mine if ext and p["ext"] == ext), None) or next((p for p in mine if not p["ext"] and p["name"] == name), None)
        if not hit:
            hit = {"id": max((p["id"] for p in have), default=0) + 1, "brand": brand, "ext": ext, "name": name}
            have.append(hit)
            out[seq] = (hit["id"], True)
        else:
            out[seq] = (hit["id"], False)
    return out


def test_resolve_in_order(spark):
    import random

    r = random.Random(5)
    for _ in range(6):
        products = [(i + 1, r.randint(1, 2), r.choice([None, None, f"e{i}"]), f"n{i}") for i in range(4)]
        rows = [(seq, r.randint(1, 2), r.choice([None, "", "e0", "e1", "x", "y", "z"]), f"n{r.randint(0, 7)}") for seq in r.sample(range(100), 40)]
        left = spark.createDataFrame(products, "id long, brand_id long, external_id string, normalized_name string")
        right = spark.createDataFrame([(s, b, e, n) for s, b, e, n in rows], "seq long, brand_id long, external_id string, normalized_name string")
        got = {x["seq"]: (x["product_id"], x["created"]) for x in writes.resolve_products(left, right).collect()}
        assert got == one_by_one(products, rows)
    none = spark.createDataFrame([], right.schema)
    assert writes.resolve_products(left, none).count() == 0


def test_arbitration(spark):
    products = spark.createDataFrame(
        [(1, 1, 10, Decimal("0.900"), "rule", None), (2, 1, None, None, None, None), (3, 2, 10, Decimal("0.500"), "rule", None), (4, 2, None, None, None, None), (5, 1, 20, Decimal("0.700"), "rule", None), (6, 3, None, None, None, None)],
        "id long, brand_id long, canonical_product_id long, canonical_match_confidence decimal(4,3), canonical_match_method string, canonical_matched_at timestamp",
    )
    p = [(1, 11, "0.800"), (2, 10, "0.900"), (3, 11, "0.500"), (4, 11, "0.600"), (99, 10, "0.900"), (5, 20, "0.700"), (6, 30, "0.900"), (6, 31, "0.500"), (6, 32, "0.900")]
    proposals = spark.createDataFrame([(a, b, Decimal(c), "rule", i) for i, (a, b, c) in enumerate(p)], "product_id long, canonical_id long, confidence decimal(4,3), method string, seq long")
    got = writes.arbitrate(products, proposals)
    want = ["kept_higher", "duplicate_brand_skipped", "assigned", "duplicate_brand_skipped", "unknown_product", "assigned", "assigned", "kept_higher", "assigned"]
    assert [r["outcome"] for r in got.orderBy("seq").collect()] == want
    after = {r["id"]: r["canonical_product_id"] for r in writes.assign(products, got, "2026-05-01").collect()}
    assert after == {1: 10, 2: None, 3: 11, 4: None, 5: 20, 6: 32}
    assert writes.arbitrate(products, proposals.limit(0)).count() == 0


def test_arbitration_in_order(spark):
    import random

    r = random.Random(2)
    for _ in range(3):
        free = [(c, b) for c in range(4) for b in range(3)]
        r.shuffle(free)
        products = []
        for i in range(10):
            c, b = free.pop() if r.random() < 0.5 else (None, r.randint(0, 2))
            products.append((i, b, c, None if c is None or r.random() < 0.2 else r.randint(1, 9) / 10))
        proposals = [(r.randint(0, 11), r.randint(0, 3), r.randint(1, 9) / 10, "rule", seq) for seq in range(60)]
        state, want = {i: [b, c, x] for i, b, c, x in products}, {}
        for i, c, x, _, seq in proposals:
            if i not in state:
                want[seq] = "unknown_product"
            elif state[i][1] is not None and state[i][2] is not None and state[i][2] > x:
                want[seq] = "kept_higher"
            elif any(k != i and v[0] == state[i][0] and v[1] == c for k, v in state.items()):
                want[seq] = "duplicate_brand_skipped"
            else:
                want[seq] = "assigned"
                state[i][1:] = [c, x]
        left = spark.createDataFrame(products, "id long, brand_id long, canonical_product_id long, canonical_match_confidence double")
        right = spark.createDataFrame(proposals, "product_id long, canonical_id long, confidence double, method string, seq long")
        assert {x["seq"]: x["outcome"] for x in writes.arbitrate(left, right).collect()} == want


def test_ingest(spark):
    schema = "id long, brand_id long, external_id string, name string, normalized_name string, category string, manufacturer_brand string, size_value decimal(10,3), size_unit string, pack_count int, variant_descriptor string, category_normalised string"
    products = spark.createDataFrame([(1, 1, "e1", "Lacta 85g", "lacta 85g", None, None, None, None, 1, None, None)], schema)
    offers = spark.createDataFrame([], "id long, product_id long, crawl_run_id long, price decimal(10,2), scraped_at timestamp, currency string")
    incoming = spark.createDataFrame([item(1, "e1", "Lacta 85g"), item(2, "", "Milk"), item(3, "e2", "Milk"), item(4, "e1", "Lacta 85g"), item(5, "e5", "", price=None)], ITEM).drop("normalized_name", "brand_id").withColumn("category", F.lit("Sweets"))
    got = writes.ingest(products, offers, incoming, (7, 1, "running"))
    assert got["counts"].collect()[0].asDict() == {"offers_persisted": 4, "products_created": 1, "products_updated": 1}
    assert [(r["product_id"], r["crawl_run_id"]) for r in got["offers"].orderBy("id").collect()] == [(1, 7), (2, 7), (2, 7), (1, 7)] and got["rejected"].count() == 1
    after = {r["id"]: r for r in got["products"].collect()}
    assert after[1]["manufacturer_brand"] == "lacta" and str(after[1]["size_value"]) == "85.000" and after[1]["category_normalised"] == "sweets" and after[2]["external_id"] is None and len(after) == 2
    try:
        writes.ingest(products, offers, incoming, (7, 1, "failed"))
        raise AssertionError("a run that has ended takes no offers")
    except ValueError:
        pass


def test_canonical_upsert_and_refresh(spark):
    schema = "id long, canonical_key string, display_name string, category string, image_url string, members_count int, brands_count int"
    now = spark.createDataFrame([(1, "k1", "A", "c", "i", 2, 2), (2, "k2", "B", "c", None, 1, 1)], schema)
    new = spark.createDataFrame([("k1", "A", "c", None, 1), ("k2", "B2", "c", "j", 2), ("k3", "C", "c", None, 3)], "canonical_key string, display_name string, category string, image_url string, seq long")
    got = {r["canonical_key"]: r for r in writes.upsert_canonicals(now, new).collect()}
    assert {k: r["outcome"] for k, r in got.items()} == {"k1": "same", "k2": "updated", "k3": "created"}
    assert got["k1"]["image_url"] == "i" and got["k2"]["image_url"] == "j" and got["k3"]["id"] == 3
    members = spark.createDataFrame([(1, 5, 3, "M", "z")], "canonical_product_id long, members_count long, brands_count long, display_name string, image_url string")
    after = {r["id"]: (r["members_count"], r["display_name"]) for r in writes.refresh_canonicals(now, members).collect()}
    assert after == {1: (5, "A"), 2: (0, "B")}


def test_bulk_upsert(spark):
    canonicals = spark.createDataFrame([(1, "k1", "A", None, 9, 9)], "id long, canonical_key string, display_name string, image_url string, members_count int, brands_count int")
    products = spark.createDataFrame([(i, b, f"n{i}", "", None, None, None, None) for i, b in ((1, 1), (2, 1), (3, 2))], "id long, brand_id long, name string, image_url string, canonical_product_id long, canonical_match_confidence decimal(4,3), canonical_match_method string, canonical_matched_at timestamp")
    member = lambda i, c, m="rule": (i, Decimal(c), m)
    rows = [
        ("k1", "A", None, [member(1, "0.900"), member(2, "0.950")], 1), ("k2", "B", "x", [member(2, "0.500"), member(99, "0.500")], 2), ("k2", "B2", None, [member(3, "0.900")], 3), ("k3", "C", None, [], 4), ("k4", "D", None, [member(1, "0.100")], 5), ("k5", "E", None, [member(1, "0.900")], 6),
    ]
    groupings = spark.createDataFrame(rows, "canonical_key string, display_name string, image_url string, members array<struct<product_id:long,confidence:decimal(4,3),match_method:string>>, seq long")
    got = writes.bulk_upsert(canonicals, products, groupings, "2026-05-01")
    assert got["counts"].collect()[0].asDict() == {"created": 3, "updated": 0, "products_assigned": 4, "duplicate_brand_skipped": 1, "errors": 1}
    assert [r["canonical_key"] for r in got["rejected"].collect()] == ["k3"]
    ids = {r["canonical_key"]: r for r in got["canonicals"].collect()}
    assert ids["k2"]["display_name"] == "B2" and ids["k2"]["image_url"] == "x" and [ids[k]["members_count"] for k in ("k1", "k2", "k4", "k5")] == [0, 2, 0, 1]
    assert {r["id"]: r["canonical_product_id"] for r in got["products"].collect()} == {1: ids["k5"]["id"], 2: ids["k2"]["id"], 3: ids["k2"]["id"]}


def test_runs(spark):
    runs = spark.createDataFrame([(1, "running", None, 0, 0), (2, "success", None, 3, 3), (3, "running", None, 0, 0)], "id long, status string, finished_at timestamp, offers_found int, offers_persisted int")
    updates = spark.createDataFrame([(1, "success", 5, None), (2, "failed", 1, 1), (3, "success", 1, 9)], "id long, status string, offers_found int, offers_persisted int")
    offers = spark.createDataFrame([(1,), (1,)], "crawl_run_id long")
    got = {r["id"]: r for r in writes.finish_runs(runs, updates, offers).collect()}
    assert (got[1]["status"], got[1]["offers_persisted"], got[1]["error"]) == ("success", 2, None)
    assert got[2]["error"] == "run has ended" and got[3]["error"] == "more offers kept than found" and got[3]["status"] == "running"
    brands = spark.createDataFrame([("a", True), ("b", False)], "slug string, active boolean")
    errors = writes.start_run_errors(brands, spark.createDataFrame([("a",), ("b",), ("c",)], "slug string"))
    assert {r["slug"]: r["error"] for r in errors.collect()} == {"a": None, "b": "brand is not active", "c": "unknown brand"}


def bodies(spark, *texts):
    return spark.createDataFrame([(t, datetime.datetime(2026, 5, 1)) for t in texts], "body string, scraped_at timestamp")


def test_json_list_source(spark):
    rows = [
        {"Itemcode": "7", "ItemDescr": " Milk ", "PosPrice": "1.50", "StartPrice": 2, "Discount": "-25%", "ItemDescrLink": "/m", "PhotoData": "/p.png"},
        {"Itemcode": "8", "ItemDescr": "Leak", "PosPrice": 1, "StartPrice": 1, "Discount": ""},
        {"ItemDescr": "No code", "PosPrice": 1, "Discount": "−10%"},
    ]
    got = chains.masoutis(bodies(spark, json.dumps(rows), "{}", "oops")).orderBy("position").collect()
    assert [(r["external_id"], r["name"], str(r["price"]), r["discount_pct"], r["promo_label"]) for r in got] == [("7", "Milk", "1.50", 25, "-25%"), (None, "No code", "1.00", 10, "−10%")]
    assert str(got[0]["original_price"]) == "2.00" and got[0]["url"].endswith("/m")


def test_card_attribute_source(spark):
    card = {"productId": 5, "title": "Tea", "canonicalUrl": "/p/tea", "category": "Drinks", "regionsPrices": {"1": {"currentPrice": {"price": 2.5, "oldPrice": 3.0, "discount": {"percentageDiscount": 17}, "startDate": "2026-05-27T21:00Z", "packaging": {"text": "100g"}}}}}
    plain = {"productId": 6, "title": "Plain", "regionsPrices": {"1": {"currentPrice": {"price": 2.5}}}}
    later = {"productId": 7, "title": "Later", "regionsPrices": {"0": {}, "1": {"futurePrices": [{"price": {"price": 1, "discount": {"discountText": "-20%"}}}]}}}
    html = "".join(f"<div data-grid-data=\"{json.dumps(c).replace('&', '&amp;').replace(chr(34), '&quot;')}\"></div>" for c in (card, plain, later, card)) + '<div data-grid-data="{broken"></div>'
    got = chains.lidl(bodies(spark, html)).orderBy("position").collect()
    assert [(r["external_id"], str(r["price"]), r["discount_pct"], r["promo_label"], r["valid_from"]) for r in got] == [("5", "2.50", 17, "−17%", datetime.date(2026, 5, 27)), ("7", "1.00", None, "-20%", None)]


def test_promotion_classes(spark):
    def product(code, promos=(), struck=False, **price):
        return {"code": code, "name": f"N{code}", "url": "/p", "price": {"value": 4.0, "showStrikethroughPrice": struck, **price}, "potentialPromotions": list(promos)}

    promo = lambda t, **x: {"promotionType": t, **x}
    listed = [
        product("1", [promo("any", title="Κέρδος 15%", toDisplay=True, startDate="01/05/2026 00:00:00")], True, discountedPriceFormatted="3,40 €"),
        product("2", [promo("Grocery Buy X get Y free", title="1 + 1 free")]),
        product("3", [promo("X Plus points for Y articles")]),
        product("4"),
        product("5", [promo("Grocery Buy X get Y free"), promo("Buy X Get Percentage Off All Products", title="-10%")]),
    ]
    body = bodies(spark, json.dumps({"data": {"productList": {"products": listed}}}), "not json")
    got = {r["external_id"]: r for r in chains.ab(body).collect()}
    assert sorted(got) == ["1", "2", "5"]
    assert (str(got["1"]["price"]), str(got["1"]["original_price"]), got["1"]["discount_pct"], got["1"]["valid_from"]) == ("3.40", "4.00", 15, datetime.date(2026, 5, 1))
    assert (str(got["2"]["price"]), got["2"]["discount_pct"], got["2"]["promo_label"], got["2"]["promo_type"]) == ("4.00", None, "1+1 δώρο", "bxgy_free")
    assert got["5"]["promo_type"] == "bxg_percent" and got["5"]["original_price"] is None
    assert {r["family"]: r["products"] for r in chains.ab_families(body).collect()} == {"SHT_TRUE": 1, "BXGY_FREE": 1, "PLUS_POINTS": 1, "UNKNOWN": 1, "BXG%_no_SHT": 1}


def test_card_pages(spark):
    html = """<article class="product" data-id="11"><a href="/p/11">Oil 1L</a><img src="i.png"><span class="diagonal-line">6,00€</span><span class="price-whole">4</span><span class="price-fraction">5</span></article>
    <article class="product" data-id="12"><a href="/p/12">Plain</a><span class="price-whole">4</span><span class="price-fraction">50</span></article>"""
    got = chains.mymarket(bodies(spark, html, None)).collect()
    assert [(r["external_id"], str(r["price"]), str(r["original_price"]), r["discount_pct"]) for r in got] == [("11", "4.05", "6.00", 32)]
    html = """<div data-plugin-product='{"sku":"s1","name":"Cheese","price":3.2}'><span class="badge">-20%</span><span class="deleted">4,00 €</span></div><div data-plugin-product='{"sku":"s2","name":"No","price":1}'></div>"""
    got = chains.sklavenitis(bodies(spark, html)).collect()
    assert [(r["external_id"], r["name"], str(r["price"]), r["discount_pct"]) for r in got] == [("s1", "Cheese", "3.20", 20)]


def test_every_crawl_is_a_snapshot(spark):
    """The same page of two days gives the offers of both; a repeated row gives nothing more; deep and broken pages don't end a task."""
    days = [datetime.datetime(2026, 5, d) for d in (1, 2, 2)]
    card = '<article class="product" data-id="11"><a href="/p">Oil</a><span class="diagonal-line">6,00</span><span class="price-whole">4</span></article>'
    deep = "<div>" * 20_000 + card
    grid = '<div data-grid-data="{&quot;productId&quot;:1,&quot;title&quot;:&quot;Tea&quot;,&quot;regionsPrices&quot;:{&quot;1&quot;:{&quot;currentPrice&quot;:{&quot;price&quot;:1,&quot;oldPrice&quot;:2}}}}"></div>'
    gift = """<div data-plugin-product='{"sku":"s","name":"N","price":3}'><b class="badge">-20%</b></div>"""
    for source, page in ((chains.mymarket, deep), (chains.lidl, grid), (chains.sklavenitis, gift)):
        rows = spark.createDataFrame([(page, d) for d in days] + [(None, days[0]), ("", days[0]), (page, None)], "body string, scraped_at timestamp")
        assert sorted(str(r["scraped_at"]) for r in source(rows).collect()) == sorted(map(str, [days[0], days[1], None]))


def test_registry_and_links(spark):
    assert set(chains.PARSERS) == {"ab", "lidl", "masoutis", "my-market", "sklavenitis"}
    got = chains.campaign_links(bodies(spark, '<a href="/c/a1"><a href="/x"><a href="/c/b2"><a href="/c/a1">'), "^/c/").orderBy("position").collect()
    assert [r["url"].rpartition("/")[2] for r in got] == ["a1", "b2"]
    assert [chains.page_cap(x, 9) for x in ("5", "0", "-1", "x", None)] == [5, 9, 9, 9, 9]


def test_stream(spark, tmp_path):
    rows = [{"external_id": "1", "name": "A", "price": 1.0, "promo_label": "x", "scraped_at": "2026-05-01T10:00:00Z"}, {"external_id": "2", "name": "B", "price": 1.0, "scraped_at": "2026-05-01T10:00:00Z"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text("\n".join(map(json.dumps, rows)))
    q = ingest.write_batches(ingest.read_items(spark, str(tmp_path / "in")), str(tmp_path / "ok"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert [r["external_id"] for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == ["1"]
    assert [r["external_id"] for r in spark.read.json(str(tmp_path / "bad")).collect()] == ["2"]
