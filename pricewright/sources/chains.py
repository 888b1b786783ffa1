"""Offers from the raw responses of store chains.

Each source takes a DataFrame with the columns ``body`` (one response) and ``scraped_at`` and returns offer items in
``schema.OFFER_ITEM`` order, with ``page`` (an id of the response, if given) and ``position`` for the order on the page.
Bodies that aren't what they should be give no rows. JSON sources are column expressions; the two sources whose pages are
cards of HTML read them with the standard parser, a batch at a time.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import numbers
from ..functions.text import squeeze

ITEM = ("external_id", "name", "url", "image_url", "category", "unit", "price", "original_price", "discount_pct", "promo_label", "promo_type", "currency", "valid_from", "valid_to", "scraped_at")
MINUS = r"^\s*[-−].*[0-9]"
BASES = {"lidl": "https://www.lidl-hellas.gr", "masoutis": "https://www.masoutis.gr", "ab": "https://www.ab.gr", "mymarket": "https://www.mymarket.gr", "sklavenitis": "https://www.sklavenitis.gr"}
#: Classes of promotions at one chain, by rank, and the types of offers that the first three become.
AB_RANKS = (
    ("Buy X Get Percentage Off All Products", "BXG%_no_SHT", "bxg_percent"),
    ("Grocery Buy X get Y free", "BXGY_FREE", "bxgy_free"),
    ("Discount X Euros For Y Articles", "DISCOUNT_EUROS", "discount_euros"),
    ("Fixed Points For Threshold Promotion", "FIXED_POINTS_THRESHOLD", None),
    ("X Plus points for Y articles", "PLUS_POINTS", None),
)


def _some(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _items(rows: DataFrame, extra=()) -> DataFrame:
    kinds = {"price": "decimal(10,2)", "original_price": "decimal(10,2)", "discount_pct": "int"}
    return rows.select(*[F.col(c).cast(kinds[c]) if c in kinds else F.col(c) for c in ITEM], *extra)


def _first_of_page(rows: DataFrame) -> DataFrame:
    """One item of each id or name of a page of one crawl, the first."""
    key = F.coalesce("external_id", "name")
    by = Window.partitionBy("body_id", key).orderBy("position")
    return rows.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def _unescape(c: Column) -> Column:
    for old, new in (("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "), ("&amp;", "&")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def _numbered(bodies: DataFrame) -> DataFrame:
    """A page as it was at one time: the same page of another crawl is a snapshot of its own, a repeated row is not."""
    return bodies.withColumn("body_id", F.xxhash64("body", "scraped_at"))


LIDL_PRICE = "struct<price:string,oldPrice:string,discount:struct<percentageDiscount:string,deletedPrice:string,discountText:string>,packaging:struct<text:string>,startDate:string,endDate:string,currencyCode:string>"
LIDL = (
    f"struct<productId:string,title:string,canonicalUrl:string,category:string,image:string,image_V1:string,imageList:array<struct<image:string>>,imageList_V1:array<struct<image:string>>,"
    f"regionsPrices:map<string,struct<currentPrice:{LIDL_PRICE},futurePrices:array<struct<price:{LIDL_PRICE}>>>>>"
)


def lidl(bodies: DataFrame) -> DataFrame:
    """Pages whose cards carry their data in an attribute. The first region with a price counts, a running one before a coming one."""
    raw = F.posexplode(F.regexp_extract_all("body", F.lit('data-grid-data="([^"]+)"'), F.lit(1)))
    rows = _numbered(bodies).select("body_id", "scraped_at", raw.alias("position", "raw"))
    rows = rows.withColumn("d", F.from_json(_unescape(F.col("raw")), LIDL)).where("d is not null")
    priced = F.transform(F.map_values("d.regionsPrices"), lambda r: F.when(r["currentPrice"]["price"].isNotNull(), r["currentPrice"]).otherwise(F.try_element_at(r["futurePrices"], F.lit(1))["price"]))
    rows = rows.withColumn("b", F.try_element_at(F.filter(priced, lambda b: b["price"].isNotNull()), F.lit(1)))
    b = lambda c: F.col(f"b.{c}")
    sale = b("price").try_cast("decimal(10,2)")
    old = F.coalesce(b("oldPrice"), b("discount.deletedPrice")).try_cast("decimal(10,2)")
    rows = rows.withColumns({"price": sale, "original_price": numbers.real_original(old, sale), "discount_pct": numbers.in_range(b("discount.percentageDiscount").try_cast("double").cast("int"), 0, 100)})
    signal = (b("discount.percentageDiscount").try_cast("double") > 0) | b("discount.discountText").rlike(MINUS) | (old > sale)
    text = _some(b("discount.discountText"))
    label = F.when(F.col("discount_pct") > 0, F.concat(F.lit("−"), F.col("discount_pct").cast("string"), F.lit("%"))).when(F.col("original_price").isNull(), F.substring(text, 1, 80))
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))["image"]
    rows = rows.withColumns({
        "external_id": F.col("d.productId"), "name": _some(F.col("d.title")), "url": numbers.absolute_url(F.col("d.canonicalUrl"), BASES["lidl"]),
        "image_url": F.coalesce(first("d.imageList_V1"), first("d.imageList"), F.col("d.image"), F.col("d.image_V1")), "category": F.col("d.category"), "unit": b("packaging.text"),
        "promo_label": label, "promo_type": F.when(label.isNotNull(), F.lit("strikethrough")), "currency": F.coalesce(_some(b("currencyCode")), F.lit("EUR")),
        "valid_from": numbers.written_date(b("startDate")), "valid_to": numbers.written_date(b("endDate")),
    })
    keep = F.col("price").isNotNull() & F.coalesce(signal, F.lit(False)) & F.col("name").isNotNull()
    return _items(_first_of_page(rows.where(keep)), ("position",))


MASOUTIS = "array<struct<Itemcode:string,ItemDescr:string,ItemDescrLink:string,PosPrice:string,StartPrice:string,Discount:string,PhotoData:string,OfferCategoryDescr:string,BrandNameDesciption:string,ItemVolume:string,StartPrItemVolume:string>>"


def masoutis(bodies: DataFrame) -> DataFrame:
    """A JSON list of products; anything else gives nothing."""
    listed = F.when(F.ltrim("body").startswith("["), F.from_json("body", MASOUTIS))
    rows = bodies.select("scraped_at", F.posexplode(listed).alias("position", "p")).select("scraped_at", "position", "p.*")
    sale = F.col("PosPrice").try_cast("decimal(10,2)")
    rows = rows.withColumns({"price": sale, "original_price": numbers.real_original(F.col("StartPrice").try_cast("decimal(10,2)"), sale), "discount_pct": numbers.parse_percent(F.col("Discount"))})
    signal = F.col("original_price").isNotNull() | F.coalesce(F.col("Discount").rlike(MINUS), F.lit(False))
    label = F.when(F.col("discount_pct") > 0, F.coalesce(_some(F.substring(squeeze(F.col("Discount")), 1, 80)), F.concat(F.lit("-"), F.col("discount_pct").cast("string"), F.lit("%"))))
    photo = F.col("PhotoData")
    rows = rows.withColumns({
        "external_id": F.nullif(F.col("Itemcode"), F.lit("")), "name": _some(F.col("ItemDescr")), "url": numbers.absolute_url(F.col("ItemDescrLink"), BASES["masoutis"]),
        "image_url": F.nullif(F.when(photo.startswith("/"), F.concat(F.lit(BASES["masoutis"]), photo)).otherwise(photo), F.lit("")),
        "category": _some(F.coalesce(F.nullif(F.col("OfferCategoryDescr"), F.lit("")), F.col("BrandNameDesciption"))), "unit": _some(F.coalesce(F.nullif(F.col("ItemVolume"), F.lit("")), F.col("StartPrItemVolume"))),
        "promo_label": label, "promo_type": F.when(label.isNotNull(), F.lit("strikethrough")), "currency": F.lit("EUR"), "valid_from": F.lit(None).cast("date"), "valid_to": F.lit(None).cast("date"),
    })
    return _items(rows.where((F.col("price") > 0) & signal & F.col("name").isNotNull()), ("position",))


AB_PROMO = "struct<promotionType:string,toDisplay:boolean,title:string,percentageDiscount:string,startDate:string,endDate:string>"
AB = (
    "struct<data:struct<productList:struct<products:array<struct<code:string,name:string,manufacturerName:string,url:string,firstLevelCategory:struct<name:string>,images:array<struct<format:string,url:string>>,"
    f"price:struct<value:string,unitPrice:string,discountedPriceFormatted:string,showStrikethroughPrice:boolean,supplementaryPriceLabel1:string>,potentialPromotions:array<{AB_PROMO}>>>>>>"
)


def ab_products(bodies: DataFrame) -> DataFrame:
    """Every product of the response with the class of its promotion and the promotion that speaks for it.

    A struck-through price comes first; else the promotions by rank, of one type the first that is displayed.
    """
    rows = bodies.select("scraped_at", F.posexplode(F.from_json("body", AB)["data"]["productList"]["products"]).alias("position", "p"))
    promos = F.coalesce(F.col("p.potentialPromotions"), F.array().cast(f"array<{AB_PROMO}>"))

    def of_type(kind: str) -> Column:
        mine = F.filter(promos, lambda x: x["promotionType"] == kind)
        shown = F.filter(mine, lambda x: F.coalesce(x["toDisplay"], F.lit(False)))
        return F.coalesce(F.try_element_at(shown, F.lit(1)), F.try_element_at(mine, F.lit(1)))

    struck = F.coalesce(F.col("p.price.showStrikethroughPrice"), F.lit(False))
    shown = F.filter(promos, lambda x: F.coalesce(x["toDisplay"], F.lit(False)))
    percent = F.filter(shown, lambda x: x["title"].contains("%"))
    family = F.when(struck, F.lit("SHT_TRUE"))
    promo = F.when(struck, F.coalesce(F.try_element_at(percent, F.lit(1)), F.try_element_at(shown, F.lit(1)), F.try_element_at(promos, F.lit(1))))
    kind = F.when(struck, F.lit("strikethrough"))
    for name, cls, offer in AB_RANKS:
        one = of_type(name)
        family, promo, kind = family.when(one.isNotNull(), cls), promo.when(one.isNotNull(), one), kind.when(one.isNotNull(), F.lit(offer))
    return rows.withColumns({"family": family.otherwise("UNKNOWN"), "promo": promo, "promo_type": kind})


def ab(bodies: DataFrame) -> DataFrame:
    """Offers of the classes that are sold: a struck-through price is the sale price; multi-buy offers keep the shelf price and no percentage."""
    rows = ab_products(bodies).where("promo_type is not null")
    struck = F.col("promo_type") == "strikethrough"
    shelf = F.col("p.price.value").try_cast("decimal(10,2)")
    sale = F.coalesce(numbers.comma_price(F.col("p.price.discountedPriceFormatted")), F.col("p.price.unitPrice").try_cast("decimal(10,2)"))
    rows = rows.withColumns({"price": F.when(struck, sale).otherwise(F.coalesce(shelf, F.col("p.price.unitPrice").try_cast("decimal(10,2)"))), "shelf": shelf})
    original = F.when(struck, numbers.real_original(F.col("shelf"), F.col("price")))
    pct = F.coalesce(numbers.in_range(F.col("promo.percentageDiscount").try_cast("double").cast("int"), 1, 100), numbers.parse_percent(F.col("promo.title")), numbers.percent_off(original, F.col("price")))
    image = lambda f: F.try_element_at(F.filter("p.images", lambda i: i["format"] == f), F.lit(1))["url"]
    picture = F.coalesce(*[image(f) for f in ("xlarge", "respListGrid", "large", "medium")], F.try_element_at(F.col("p.images"), F.lit(1))["url"])
    day = lambda c: numbers.written_date(F.col(f"promo.{c}"), "dd/MM/yyyy")
    rows = rows.withColumns({
        "external_id": F.col("p.code"), "name": _some(F.concat_ws(" ", _some(F.col("p.manufacturerName")), _some(F.col("p.name")))), "url": numbers.absolute_url(F.col("p.url"), BASES["ab"]),
        "image_url": F.coalesce(numbers.absolute_url(picture, BASES["ab"]), picture), "category": F.col("p.firstLevelCategory.name"), "unit": F.col("p.price.supplementaryPriceLabel1"),
        "original_price": original, "discount_pct": F.when(struck, pct), "promo_label": numbers.promo_label(F.col("promo.title")), "currency": F.lit("EUR"), "valid_from": day("startDate"), "valid_to": day("endDate"),
    })
    return _items(rows.where("price is not null and name is not null"), ("position", "family"))


def ab_dump(bodies: DataFrame, page_size: int = 50) -> DataFrame:
    """One response (``body``) that lists the products of all pages as they came, by the time of the crawl and place; for tests of a parser.

    It is a file for people, so it is gathered into one row: only for the pages of one chain.
    """
    raw = F.from_json("body", "struct<data:struct<productList:struct<products:array<variant>>>>")["data"]["productList"]["products"]
    rows = bodies.select("scraped_at", F.xxhash64("body").alias("page"), F.posexplode(raw).alias("position", "p"))
    listed = rows.select(F.struct("scraped_at", "page", "position", F.to_json("p").alias("p")).alias("x"))
    got = listed.agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["p"]), ",").alias("products"), F.count("*").alias("n"))
    pages = F.greatest(F.ceil(F.col("n") / page_size), F.lit(1))
    tail = F.concat(F.lit('],"pagination":{"totalPages":'), pages.cast("string"), F.lit(',"totalResults":'), F.col("n").cast("string"), F.lit(f',"pageSize":{page_size},"currentPage":0}}}}}}}}'))
    return got.select(F.concat(F.lit('{"data":{"productList":{"products":['), F.coalesce("products", F.lit("")), tail).alias("body"))


def ab_families(bodies: DataFrame) -> DataFrame:
    """How many products each class of promotion has, those that aren't offers included."""
    return ab_products(bodies).groupBy("family").agg(F.count("*").alias("products"))


def ab_promotion_sets(bodies: DataFrame, rows: int = 20) -> DataFrame:
    """The commonest sets of promotion types on one product."""
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("p.potentialPromotions", lambda x: x["promotionType"]))), " + ")
    return ab_products(bodies).groupBy(kinds.alias("types")).agg(F.count("*").alias("products")).orderBy(F.desc("products"), "types").limit(rows)


class _Cards(HTMLParser):
    """Elements as (tag, attributes, children, text) trees; only what the card sources look for is kept simple."""

    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = {"tag": "", "attrs": {}, "kids": []}
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "attrs": {k: v or "" for k, v in attrs}, "kids": []}
        self.open[-1]["kids"].append(node)
        if tag not in self.VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i]["tag"] == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1]["kids"].append(data)


def _walk(node):
    """All elements below, in page order, however deep."""
    stack = [iter(node["kids"])]
    while stack:
        kid = next(stack[-1], None)
        if kid is None:
            stack.pop()
        elif isinstance(kid, dict):
            yield kid
            stack.append(iter(kid["kids"]))


def _text(node) -> str:
    parts, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        else:
            stack.extend(reversed(x["kids"]))
    return " ".join(" ".join(parts).split())


def _has(node, cls: str) -> bool:
    return cls in node["attrs"].get("class", "").split()


def _cards(html: str, is_card):
    try:
        p = _Cards()
        p.feed(html or "")
        p.close()
    except (AssertionError, ValueError):
        return
    yield from (n for n in _walk(p.root) if is_card(n))


def _json(text: str | None):
    try:
        got = json.loads(text or "")
        return got if isinstance(got, dict) else {}
    except ValueError:
        return {}


#: Class names and attributes of the two chains' cards.
MYMARKET = {"card": "product", "data": "data-google-analytics-item-value", "unit": "measure-label", "whole": "price-whole", "fraction": "price-fraction", "price": "selling-unit-price", "old": "diagonal-line", "percent": "discount-pill", "label": "product-note-tag"}
SKLAVENITIS = {"card": "product", "data": ("data-plugin-product", "data-item"), "badge": ("icon-offer", "offer-span", "badge"), "name": "product__title", "unit": "priceKil", "price": "price", "old": "deleted"}
CARD = "body_id long, position int, external_id string, name string, href string, image_url string, category string, unit string, whole string, fraction string, price_text string, old_text string, pct_text string, label string, struck boolean, gift boolean"
COLUMNS = [c.split()[0] for c in CARD.split(", ")]


def _mymarket_cards(html: str):
    k = MYMARKET
    for n, card in enumerate(_cards(html, lambda x: x["tag"] == "article" and _has(x, k["card"]))):
        inside = list(_walk(card))
        find = lambda part: next((x for x in inside if _has(x, k[part])), None)
        of = lambda part: _text(x) if (x := find(part)) else None
        data = _json(card["attrs"].get(k["data"]) or next((x["attrs"][k["data"]] for x in inside if k["data"] in x["attrs"]), None))
        link = next((x for x in inside if x["tag"] == "a" and x["attrs"].get("href")), None)
        image = next((x["attrs"].get("src") for x in inside if x["tag"] == "img"), None)
        item = (((data.get("Call") or {}).get("ecommerce") or {}).get("items") or [{}])[0] if "Call" in data else data
        yield {
            "position": n, "external_id": str(item.get("id") or item.get("item_id") or card["attrs"].get("data-id") or "") or None, "name": item.get("name") or item.get("item_name") or (_text(link) if link else None),
            "href": link["attrs"]["href"] if link else None, "image_url": image, "category": item.get("category") or item.get("item_category"), "unit": of("unit"),
            "whole": of("whole"), "fraction": of("fraction"), "price_text": of("price"), "old_text": of("old"), "pct_text": of("percent"), "label": of("label"), "struck": find("old") is not None, "gift": False,
        }


def _sklavenitis_cards(html: str):
    k = SKLAVENITIS
    first, second = k["data"]
    for n, card in enumerate(_cards(html, lambda x: first in x["attrs"] or _has(x, k["card"]) and second in x["attrs"])):
        inside = list(_walk(card))
        of = lambda cls: next((_text(x) for x in inside if _has(x, cls)), None)
        data = _json(card["attrs"].get(first) or card["attrs"].get(second))
        link = next((x for x in inside if x["tag"] == "a" and x["attrs"].get("href")), None)
        image = next((x["attrs"].get("src") or x["attrs"].get("data-src") for x in inside if x["tag"] == "img"), None)
        badge = next((text for cls in k["badge"] if (text := of(cls))), None)
        yield {
            "position": n, "external_id": str(data.get("sku") or data.get("ProductSKU") or "") or None, "name": data.get("name") or of(k["name"]) or (_text(link) if link else None), "href": link["attrs"]["href"] if link else None,
            "image_url": image, "category": data.get("category"), "unit": of(k["unit"]), "whole": None, "fraction": None, "price_text": str(data["price"]) if data.get("price") is not None else of(k["price"]),
            "old_text": of(k["old"]), "pct_text": badge, "label": badge, "struck": False, "gift": badge is not None,
        }


def _read_cards(bodies: DataFrame, cards) -> DataFrame:
    def run(batches):
        for pdf in batches:
            rows = [{"body_id": i, "scraped_at": at, **c} for i, at, html in zip(pdf["body_id"], pdf["scraped_at"], pdf["body"], strict=True) for c in cards(html)]
            yield pd.DataFrame(rows, columns=["body_id", "scraped_at", *COLUMNS[1:]])

    at = bodies.schema["scraped_at"].dataType.simpleString()
    return _numbered(bodies).select("body_id", "scraped_at", "body").mapInPandas(run, CARD.replace("body_id long,", f"body_id long, scraped_at {at},"))


def _card_items(rows: DataFrame, base: str, keep: Column) -> DataFrame:
    sale = F.coalesce(numbers.compose_price(F.col("whole"), F.col("fraction")), numbers.parse_price(F.col("price_text")).cast("decimal(10,2)"))
    rows = rows.withColumn("price", sale)
    rows = rows.withColumn("original_price", numbers.real_original(numbers.parse_price(F.col("old_text")).cast("decimal(10,2)"), F.col("price")))
    rows = rows.withColumn("discount_pct", F.coalesce(numbers.parse_percent(F.col("pct_text")), numbers.percent_off(F.col("original_price"), F.col("price"))))
    rows = rows.withColumns({
        "name": _some(squeeze(F.col("name"))), "url": numbers.absolute_url(F.col("href"), base), "promo_label": numbers.promo_label(F.coalesce("label", "pct_text")), "promo_type": F.when(F.col("discount_pct") > 0, F.lit("strikethrough")),
        "currency": F.lit("EUR"), "valid_from": F.lit(None).cast("date"), "valid_to": F.lit(None).cast("date"),
    })
    return _items(_first_of_page(rows.where(keep & (F.col("price") > 0) & F.col("name").isNotNull())), ("position",))


def mymarket(bodies: DataFrame) -> DataFrame:
    """Cards with a crossed-out price or a percent pill."""
    return _card_items(_read_cards(bodies, _mymarket_cards), BASES["mymarket"], F.col("struck") | numbers.parse_percent(F.col("pct_text")).isNotNull())


def sklavenitis(bodies: DataFrame) -> DataFrame:
    """Cards with an offer badge."""
    return _card_items(_read_cards(bodies, _sklavenitis_cards), BASES["sklavenitis"], F.col("gift"))


#: Sources by chain.
PARSERS = {"ab": ab, "lidl": lidl, "masoutis": masoutis, "my-market": mymarket, "sklavenitis": sklavenitis}


def campaign_links(bodies: DataFrame, pattern: str, base: str = BASES["lidl"], cap: int = 200) -> DataFrame:
    """Links of a landing page that look like campaigns, each once, in order of appearance, at most so many."""
    links = F.array_distinct(F.filter(F.regexp_extract_all("body", F.lit('href="([^"]+)"'), F.lit(1)), lambda u: u.rlike(pattern)))
    return bodies.select(F.posexplode(F.slice(links, 1, cap)).alias("position", "u")).select("position", numbers.absolute_url(F.col("u"), base).alias("url"))


def page_cap(text: str | None, default: int) -> int:
    """A positive number from the settings, else the default."""
    return int(text) if text and re.fullmatch(r"[0-9]+", text.strip()) and int(text) > 0 else default
