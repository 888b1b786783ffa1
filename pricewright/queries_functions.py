"""Registered queries of the functions and read plans: texts made of the parts' columns, so that SQL knows what has to come out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import numbers, text
from .operators import core
from .plans import canonical, families, offers, paging, resources
from .queries import DAY, FAMILY_OUT, FEED, KEY, PRICING, _days, _family_sql, _feed_sql, _named
from .registry import query
from .sources.retail import star_views

#: The letters of both tables, each once, as SQL's translate takes them.
_LATIN = {g: x for g, x in zip("σ" + text.GREEK, "s" + text.LATIN, strict=True)}
_LOOK = dict(zip(text.LOOKALIKE_GREEK, text.LOOKALIKE_LATIN, strict=True))
_translate = lambda col, table: f"translate({col}, '{''.join(table)}', '{''.join(table.values())}')"
GREEK_NAMES = "concat(case p_partkey % 4 when 0 then '  Θέρμη ' when 1 then 'Ψωμί   ΟΛΙΚΉΣ ' when 2 then 'Γάλα ΦΡΈΣΚΟ ' else ' ' end, case when p_partkey % 9 = 0 then '' else p_name end, ' ')"


@query(f"""
with n as (select p_partkey as id, {GREEK_NAMES} as name from part), s as (select *, trim(regexp_replace(strip_accents(lower(name)), '\\s+', ' ', 'g')) as norm from n),
k as (select *, replace(replace(replace(replace(replace(norm, 'lt', 'l'), 'λτ', 'l'), 'λιτ', 'l'), 'γρ', 'g'), 'gr', 'g') as key from s)
select id, {_translate("replace(replace(norm, 'θ', 'th'), 'ψ', 'ps')", _LATIN)} as latin, nullif(trim(regexp_replace(name, '\\s+', ' ', 'g')), '') as clean, replace({_translate("key", _LOOK)}, 'ς', 'σ') as folded from k""")
def name_functions(spark, sf_dir):
    n = F.col("name")
    return _named(spark, sf_dir, GREEK_NAMES).select("id", text.to_latin(text.normalize(n)).alias("latin"), text.clean_text(n).alias("clean"), F.translate(text.match_key(n, fold_letters=True), "ς", "σ").alias("folded"))


#: Cents of a price and of the one before, and texts that hold numbers.
PRICED = """select p_partkey as id, p_size * 37 % 400 + 100 as c, p_size * 53 % 500 + 90 as o, p_size as n, concat(p_partkey % 3 + 1, '.', lpad(cast(p_size * 13 % 1000 as varchar(9)), 3, '0'), ',', lpad(cast(p_size as varchar(9)), 2, '0'), ' €') as grouped,
  case p_partkey % 3 when 0 then '5' when 1 then '50 λ' end as cents, concat('  ', p_size % 25, ' +  ', p_size % 7, '  FREE ') as buys, concat('Κέρδος ', p_size % 9, ',50€') as gain from part"""


@query(f"""
with p as ({PRICED})
select id, ((id % 3 + 1) * 1000 + n * 13 % 1000 + n / 100.0)::double as comma_price, (n + case id % 3 when 0 then 0.05 when 1 then 0.5 else 0 end)::double as composed,
  (case when o > c then round_even((o - c) * 100.0 / o, 0) end)::double as percent_off, (case when o > c then o end)::double as real_original, (case when n between 5 and 40 then n end)::double as ranged,
  (case when n % 25 between 1 and 20 and n % 7 between 1 and 20 then n % 25 end)::double as buy, (case when n % 25 between 1 and 20 and n % 7 between 1 and 20 then n % 7 end)::double as free, (n % 9 + 0.5)::double as gain,
  (n % 25) || '+' || (n % 7) || ' δώρο' as label, round((o - c)::double, 2) as saved, (case when o > 0 then round((o - c)::double / o * 100) else 0 end)::double as saved_pct from p""")
def price_functions(spark, sf_dir):
    rows = spark.sql(PRICED.replace("from part", "from {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    c, o = F.col("c").cast("decimal(10,2)"), F.col("o").cast("decimal(10,2)")
    buy, saved = numbers.multi_buy(F.col("buys")), numbers.savings(F.col("c").cast("double"), F.col("o").cast("double"))
    values = {
        "comma_price": numbers.comma_price(F.col("grouped")), "composed": numbers.compose_price(F.col("n").cast("string"), F.col("cents")), "percent_off": numbers.percent_off(o, c), "real_original": numbers.real_original(o, c),
        "ranged": numbers.in_range(F.col("n").cast("string"), 5, 40), "buy": buy["buy"], "free": buy["free"], "gain": numbers.euro_discount(F.col("gain")), "saved": saved[0], "saved_pct": saved[1],
    }
    return rows.select("id", *[v.cast("double").alias(k) for k, v in values.items()], numbers.promo_label(F.col("buys")).alias("label"))


RANGES = "concat('Από ', p_size % 28 + 1, '/', p_size % 12 + 1, ' έως ', p_size % 27 + 2, '/', p_size % 12 + 1, '/', 2024 + p_size % 3)"


@query("""
with d as (select p_partkey as id, p_size as n, date '2026-01-01' + (p_size % 14 - 2)::int as until from part)
select id, cast(make_date(2026, n % 12 + 1, n % 28 + 1) as varchar) as valid_from, cast(make_date(2024 + n % 3, n % 12 + 1, n % 27 + 2) as varchar) as valid_to, cast(until as varchar) as written,
  case when until < date '2026-01-01' then 'expired' when until = date '2026-01-01' then 'today' when until = date '2026-01-02' then 'tomorrow' when until <= date '2026-01-08' then (until - date '2026-01-01') || ' days' else strftime(until, '%-d %b') end as label from d""")
def date_functions(spark, sf_dir):
    rows = spark.sql(f"select p_partkey as id, {RANGES} as days, date_add(date '2026-01-01', p_size % 14 - 2) as until from {{part}}", part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    both = numbers.parse_date_range(F.col("days"), 2026)
    written = numbers.written_date(F.concat(F.date_format("until", "yyyy-MM-dd"), F.lit("T21:00:00+03:00")))
    return rows.select("id", both["valid_from"].cast("string").alias("valid_from"), both["valid_to"].cast("string").alias("valid_to"), written.cast("string").alias("written"), numbers.days_left(F.col("until"), "2026-01-01").alias("label"))


LINKS = "case p_partkey % 3 when 0 then concat('/p/', p_partkey) when 1 then concat('https://x.gr/', p_partkey) else concat('p', p_partkey) end"


@query(f"with n as (select p_partkey as id, {LINKS} as name from part) select id, case id % 3 when 0 then 'https://a.gr' || name when 1 then name end as url, 'query: ' || name as asked from n")
def link_functions(spark, sf_dir):
    from .operators import resolve

    return _named(spark, sf_dir, LINKS).select("id", numbers.absolute_url(F.col("name"), "https://a.gr").alias("url"), resolve.vector_text(F.col("name")).alias("asked"))


@query("""
select id, concat(manufacturer_brand, '|', coalesce(category_normalised, ''), '|', cast(cast(size_value as int) as varchar), '|', size_unit, '|1') as family_key,
  upper(manufacturer_brand[1]) || manufacturer_brand[2:] || ' ' || coalesce(upper(category_normalised[1]) || category_normalised[2:], '') || ' ' || cast(cast(size_value as int) as varchar) || size_unit as display_name
from v_products p where manufacturer_brand is not null and (brand_id % 5) <> 1""")
def family_names(spark, sf_dir):
    return families.members(star_views(spark, sf_dir)).select("id", families.family_key().alias("family_key"), families.display_name().alias("display_name"))


@query("select p_partkey as id, case when p_partkey % 4 = 0 then null else greatest(p_size, p_partkey % 60) end::double as pages from part")
def total_page_probe(spark, sf_dir):
    html = "case when p_partkey % 4 = 0 then concat('<a>', p_name, '</a>') else concat('<a data-mkey=\"page-', p_size, '\">x</a><b data-mkey=\"page-', p_partkey % 60, '\">') end"
    return _named(spark, sf_dir, html).select("id", paging.total_pages(F.col("name")).cast("double").alias("pages"))


@query("""
with p as (select o_custkey as crawl, o_orderkey as page, (o_orderkey % 50)::int as n from orders),
stop as (select crawl, min(page) as last from p where n < 25 group by 1)
select p.crawl, count(*) as pages, cast(sum(n) as bigint) as rows from p left join stop using (crawl) where last is null or page <= last group by 1""")
def short_page_stop(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("crawl_id"), F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 50).alias("rows"))
    return paging.until_short_page(rows, full=25).groupBy(F.col("crawl_id").alias("crawl")).agg(F.count("*").alias("pages"), F.sum("rows").alias("rows"))


@query("""
with p as (select o_custkey as crawl, o_orderkey as page, o_orderkey % 3 = 0 as none, row_number() over (partition by o_custkey order by o_orderkey) as nn from orders),
r as (select *, nn - row_number() over (partition by crawl, none order by nn) as island from p),
e as (select crawl, island, min(page) as first_id, count(*) as streak from r where none group by 1, 2 having count(*) >= 2),
stop as (select crawl, min(first_id) + 1 as last from e group by 1)
select p.crawl, count(*) as pages from p left join stop using (crawl) where (last is null or page <= last) and page <= 14000 group by 1""")
def empty_page_stop(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("crawl_id"), F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 3).alias("emitted"))
    return paging.pages_read(rows, stop_after=2, cap=14000).groupBy(F.col("crawl_id").alias("crawl")).agg(F.count("*").alias("pages"))


@query("select p_name, min(p_partkey) as id from part group by 1")
def first_of_each_name(spark, sf_dir):
    return paging.first_seen(spark.read.parquet(f"{sf_dir}/part.parquet"), ["p_name"], ["p_partkey"]).select("p_name", F.col("p_partkey").alias("id"))


@query("""
select o.id, cast(o.price as double) as price, p.id as product_id, p.name, b.slug as brand from v_offers o join v_products p on p.id = o.product_id join v_brands b on b.id = p.brand_id
where o.id = (select max(id) from v_offers where product_id = 7)""")
def offer_detail(spark, sf_dir):
    t = star_views(spark, sf_dir)
    newest = t.offers.where("product_id = 7").agg(F.max("id")).first()[0]
    return offers.offer(t, newest).select("id", F.col("price").cast("double").alias("price"), "product_id", F.col("product.name").alias("name"), F.col("brand.slug").alias("brand"))


@query(_feed_sql("and b.slug = 'nation_2'", order="coalesce(discount_pct, 0) desc, id desc"))
def brand_offers(spark, sf_dir):
    return _days(offers.brand_feed(star_views(spark, sf_dir), "nation_2", valid_on=DAY).select(*FEED))


@query(_feed_sql("and p.normalized_name like '%e%'", order="price asc, id desc") + " offset 50")
def search_second_page(spark, sf_dir):
    return _days(offers.search(star_views(spark, sf_dir), "E", valid_on=DAY, sort="price", dir="asc", page=2).select(*FEED))


@query(_feed_sql().replace("select id, product_id, brand, name, category, price, original_price, discount_pct, valid_from, valid_to from feed", "select count(*) as total, greatest(1, cast(ceil(count(*) / 50.0) as bigint)) as last_page, 3 as current_page, 50 as per_page from feed"))
def page_totals(spark, sf_dir):
    found = core.envelope(offers.matching_offers(star_views(spark, sf_dir), valid_on=DAY), 3, 50)
    return spark.createDataFrame([found], "total long, last_page long, current_page int, per_page int")


@query("""
select o.id, cast(o.price as double) as price, p.id as product_id, p.name, p.image_url, b.slug as brand, b.name as brand_name
from v_offers o join v_products p on p.id = o.product_id join v_brands b on b.id = p.brand_id""")
def offer_resource_rows(spark, sf_dir):
    t = star_views(spark, sf_dir)
    rows = resources.offer_resources(t, t.offers)
    return rows.select("id", F.col("price").cast("double").alias("price"), F.col("product.id").alias("product_id"), F.col("product.name").alias("name"), F.col("product.image_url").alias("image_url"), F.col("product.brand.slug").alias("brand"), F.col("product.brand.name").alias("brand_name"))


def _families_where(condition: str) -> str:
    return _family_sql(gate=f"where {condition}")


@query(_families_where("mem.manufacturer_brand = 'brand#13' and mem.category_normalised = 'economy'"))
def families_of_maker(spark, sf_dir):
    return families.families(star_views(spark, sf_dir), valid_on=DAY, manufacturer="Brand#13", category="ECONOMY").select(*FAMILY_OUT)


@query(PRICING + " select * from member left join pricing using (canonical_product_id) where brands_count >= 2 and display_name ilike '%ring%'")
def canonical_text_search(spark, sf_dir):
    return canonical.canonicals(star_views(spark, sf_dir), q="RING")


@query(PRICING + " select * from member left join pricing using (canonical_product_id) where brands_count >= 2 and canonical_product_id in (select canonical_product_id from v_products where category in ('promo', 'PROMO', 'Promo'))")
def canonical_of_category(spark, sf_dir):
    return canonical.canonicals(star_views(spark, sf_dir), category="promo")


@query(PRICING + " select canonical_product_id from member where brands_count >= 2 order by brands_count desc, members_count desc, canonical_product_id limit 100")
def top_canonical_ids(spark, sf_dir):
    return canonical.top_canonicals(star_views(spark, sf_dir))


@query(PRICING + """ select canonical_product_id as id, display_name, members_count, min_price as least, max_price as most, avg_price as mean, cheapest_brand
from member left join pricing using (canonical_product_id) where brands_count >= 2""")
def canonical_list_resource(spark, sf_dir):
    rows = resources.canonical_list(canonical.canonicals(star_views(spark, sf_dir)))
    return rows.select("id", "display_name", "members_count", F.col("prices.min").alias("least"), F.col("prices.max").alias("most"), F.col("prices.avg").alias("mean"), "cheapest_brand")


@query(f"""
, now as (
  select o.* from v_offers o where o.id in (select max(id) from v_offers group by product_id)
    and (o.valid_from is null or o.valid_from <= date '{DAY}') and (o.valid_to is null or o.valid_to >= date '{DAY}')
)
select p.canonical_product_id as id, count(*)::int as offers, min(cast(o.price as double)) as min_price, max(cast(o.price as double)) as max_price, round(max(cast(o.price as double)) - min(cast(o.price as double)), 2) as price_savings,
  arg_min(b.slug, (cast(o.price as double), o.id)) as cheapest_brand
from now o join v_products p on p.id = o.product_id join v_brands b on b.id = p.brand_id where p.canonical_product_id is not null group by 1""")
def canonical_detail_resource(spark, sf_dir):
    return resources.canonical_detail(canonical.comparison(star_views(spark, sf_dir), DAY)).withColumn("offers", F.size("offers"))


@query(f"""
, latest as (
  select o.product_id, o.price from v_offers o where o.id in (select max(id) from v_offers group by product_id)
    and (o.valid_from is null or o.valid_from <= date '{DAY}') and (o.valid_to is null or o.valid_to >= date '{DAY}')
), fam as (
  select p.id, p.category, p.category_normalised, p.image_url, b.slug as brand, cast(l.price as double) as price, coalesce(nullif(p.variant_descriptor, ''), '—') as variant
  from v_products p join v_brands b on b.id = p.brand_id left join latest l on l.product_id = p.id
  where b.active and manufacturer_brand = 'brand#13' and category_normalised = 'economy' and size_value = 5 and size_unit = 'ml' and pack_count = 1)
select '{KEY}' as family_key, 'Brand#13 Economy 5ml' as display_name, max(category) as category, max(category_normalised) as category_normalised, arg_min(image_url, id) filter (where image_url <> '') as image_url,
  count(*) as variants_count, count(distinct brand) as brands_count, min(price) as min_price, max(price) as max_price, round(avg(price) + 1e-7, 2) as avg_price, count(distinct variant)::int as variants from fam having count(*) > 0""")
def family_detail_resource(spark, sf_dir):
    row = resources.family_detail(star_views(spark, sf_dir), KEY, DAY)
    return row.select("family_key", "display_name", "category", "category_normalised", "image_url", "variants_count", "brands_count", "min_price", "max_price", "avg_price", F.size("variants").alias("variants"))


@query("select id, brand_id, status, strftime(finished_at, '%Y-%m-%dT%H:%M:%SZ') as finished_at, 0 as offers_found from v_runs")
def run_resource_rows(spark, sf_dir):
    runs = star_views(spark, sf_dir).runs.withColumns({"started_at": F.lit(None).cast("timestamp"), "finished_at": F.col("finished_at").cast("timestamp"), "offers_found": F.lit(None).cast("int"), "offers_persisted": F.lit(None).cast("int"), "error_message": F.lit(None).cast("string"), "triggered_by": F.lit("api")})
    return resources.run_resources(runs).select("id", "brand_id", "status", "finished_at", "offers_found")


def requests(spark) -> DataFrame:
    """Parameters as they come from an address, read without ever failing."""
    given = [{"brand": "a,,b", "min_discount": "120", "dir": "up", "page": "-3"}, {"has_discount": ["1", "0"], "sort": "price", "dir": "asc", "page": "7"}, {"q": "  milk ", "min_discount": "x", "category": ""}]
    rows = [resources.parse_query(g).params() for g in given]
    return spark.createDataFrame([(i, r["brand"], r["category"], r["min_discount"], r["has_discount"], r["q"], r["sort"], r["dir"], r["page"]) for i, r in enumerate(rows)], "n int, brand string, category string, min_discount int, has_discount boolean, q string, sort string, dir string, page int")


@query("""
select * from (values (0, 'a,b', null::varchar, 100::double, null::boolean, null::varchar, 'discount_pct', 'desc', 1), (1, null, null, null, true, null, 'price', 'asc', 7), (2, null, null, null, null, 'milk', 'discount_pct', 'desc', 1))
  t(n, brand, category, min_discount, has_discount, q, sort, dir, page)""")
def request_parameters(spark, sf_dir):
    return requests(spark).withColumn("min_discount", F.col("min_discount").cast("double"))


@query("select p_partkey as id, case p_partkey % 3 when 0 then 'pgae, zz' when 1 then '' else 'limit' end as unknown from part")
def unknown_parameters(spark, sf_dir):
    given = F.when(F.col("id") % 3 == 0, F.create_map(F.lit("zz"), F.lit(1), F.lit("page"), F.lit(2), F.lit("pgae"), F.lit(3))).when(F.col("id") % 3 == 2, F.create_map(F.lit("limit"), F.lit(1)))
    return _named(spark, sf_dir, "p_name").select("id", F.array_join(core.unknown_keys(given, ("page", "q")), ", ").alias("unknown"))


@query("""
select p.id from v_products p where exists (
  select 1 from v_products w where w.id % 50 = 0 and w.manufacturer_brand is not distinct from p.manufacturer_brand and w.category_normalised is not distinct from p.category_normalised
    and w.size_value is not distinct from p.size_value and w.size_unit is not distinct from p.size_unit and w.pack_count is not distinct from p.pack_count)""")
def products_of_families(spark, sf_dir):
    p = star_views(spark, sf_dir).products
    return core.in_tuples(p, p.where("id % 50 = 0"), families.FAMILY).select("id")


@query("select n, case when n < 1 then 'no items' when n > 500 then 'more than 500 items' end as error from (select p_partkey as id, p_partkey % 700 as n from part)")
def batch_sizes(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select((F.col("p_partkey") % 700).alias("n")).select("n", core.batch_errors(F.col("n")).alias("error"))


@query("select distinct p.category from v_products p join v_brands b on b.id = p.brand_id where b.active and category is not null and category <> ''")
def categories_remembered(spark, sf_dir):
    kept = core.Remembered(lambda: offers.categories(star_views(spark, sf_dir)))
    first, second = kept.get(), kept.get()
    return spark.createDataFrame(second if first is second else [], "category string")
