"""The registered queries over the star-schema tables, and the same in SQL."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import numbers, text
from .operators import core, resolve, writes
from .plans import canonical, families, offers
from .registry import QUERIES, SQL, query
from .sources.retail import star_views

DAY = "1998-06-01"
FEED = ("id", "product_id", "brand", "name", "category", "price", "original_price", "discount_pct", "valid_from", "valid_to")
FAMILY_OUT = ("family_key", "category", "variants_count", "brands_count", "min_price", "max_price", "avg_price", "cheapest_brand", "image_url")

def _days(df: DataFrame) -> DataFrame:
    """Dates as text and numbers that may be null as doubles, which both engines hand on alike."""
    kinds = {"valid_from": "string", "valid_to": "string", "discount_pct": "double"}
    return df.withColumns({c: F.col(c).cast(k) for c, k in kinds.items() if c in df.columns})


def _feed_sql(where: str = "", order: str = "", join: str = "") -> str:
    tail = f"order by {order} limit 50" if order else ""
    return f"""
, hit as (
  select o.id, o.product_id, b.slug as brand, p.name, p.category, o.price, o.original_price, cast(o.discount_pct as double) as discount_pct,
         cast(o.valid_from as varchar) as valid_from, cast(o.valid_to as varchar) as valid_to, o.scraped_at
  from v_offers o join v_products p on p.id = o.product_id join v_brands b on b.id = p.brand_id
  where b.active and (o.valid_from is null or o.valid_from <= date '{DAY}') and (o.valid_to is null or o.valid_to >= date '{DAY}') {where}
), feed as (select * from hit where id in (select max(id) from hit group by product_id))
select {", ".join(FEED)} from feed {tail}"""


@query(_feed_sql(order="coalesce(discount_pct, 0) desc, id desc"))
def offers_feed_latest(spark, sf_dir):
    return _days(offers.feed(star_views(spark, sf_dir), valid_on=DAY).select(*FEED))


@query(_feed_sql(order="price asc, id desc"))
def offers_feed_by_price(spark, sf_dir):
    return _days(offers.feed(star_views(spark, sf_dir), valid_on=DAY, sort="price", dir="asc").select(*FEED))


@query(_feed_sql(order="scraped_at desc, id desc"))
def offers_feed_by_scraped(spark, sf_dir):
    return _days(offers.feed(star_views(spark, sf_dir), valid_on=DAY, sort="scraped_at").select(*FEED))


@query(_feed_sql("and o.discount_pct >= 5"))
def offers_min_discount(spark, sf_dir):
    return _days(offers.matching_offers(star_views(spark, sf_dir), valid_on=DAY, min_discount=5).select(*FEED))


@query(_feed_sql("and o.original_price is not null and o.original_price > o.price"))
def offers_has_discount(spark, sf_dir):
    return _days(offers.matching_offers(star_views(spark, sf_dir), valid_on=DAY, has_discount=True).select(*FEED))


@query(_feed_sql())
def offers_valid_on(spark, sf_dir):
    return _days(offers.matching_offers(star_views(spark, sf_dir), valid_on=DAY).select(*FEED))


@query(_feed_sql("and b.slug in ('nation_0', 'nation_4', 'france', 'germany')"))
def offers_brand_csv(spark, sf_dir):
    return _days(offers.matching_offers(star_views(spark, sf_dir), valid_on=DAY, brand="nation_0, nation_4,,france,germany").select(*FEED))


@query(_feed_sql("and p.category in ('promo', 'PROMO', 'Promo')"))
def offers_category_variants(spark, sf_dir):
    return _days(offers.matching_offers(star_views(spark, sf_dir), valid_on=DAY, category="promo").select(*FEED))


@query(_feed_sql("and p.normalized_name like '%economy%ring%'"))
def offers_text_search(spark, sf_dir):
    return _days(offers.matching_offers(star_views(spark, sf_dir), valid_on=DAY, q="Economy%Ring").select(*FEED))


@query("select id, product_id % 5 as product_id, price, cast(discount_pct as double) as discount_pct from v_offers where product_id % 5 = 2 order by scraped_at desc, id desc limit 200")
def offer_history_200(spark, sf_dir):
    """Five products share all offers, so each has more snapshots than are shown."""
    t = star_views(spark, sf_dir)
    t = replace(t, offers=t.offers.withColumn("product_id", F.col("product_id") % 5))
    return _days(offers.history(t, 2).drop("scraped_at"))


@query("select user_id as product_id, arg_max(event_id, (ts, event_id)) as id from events group by 1")
def latest_snapshot(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return offers.latest_snapshot(rows.select(F.col("user_id").alias("product_id"), F.col("event_id").alias("id"), F.col("ts").alias("scraped_at")))


@query("""
select event_id as id, user_id as product_id, cast(row_number() over (partition by user_id order by ts, event_id) as int) as position,
       min(value) over w as min_price, max(value) over w as max_price, value = min(value) over w as cheapest
from events window w as (partition by user_id)""")
def history_extent(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("id"), F.col("user_id").alias("product_id"), F.col("value").alias("price"), F.col("ts").alias("scraped_at"))
    return offers.history_extent(rows).select("id", "product_id", "position", "min_price", "max_price", "cheapest")


def _family_sql(hit: str = "true", gate: str = "", tail: str = "") -> str:
    tup = "manufacturer_brand, category_normalised, size_value, size_unit, pack_count"
    return f"""
, mem as (
  select p.*, b.slug as brand from v_products p join v_brands b on b.id = p.brand_id
  where b.active and manufacturer_brand is not null and size_value is not null and size_unit is not null
), latest as (
  select o.product_id, o.price from v_offers o
  where o.id in (select max(id) from v_offers group by product_id)
    and (o.valid_from is null or o.valid_from <= date '{DAY}') and (o.valid_to is null or o.valid_to >= date '{DAY}')
), priced as (
  select mem.*, cast(l.price as double) as price, coalesce({hit}, false) as hit from mem left join latest l on l.product_id = mem.id
  {gate}
), fam as (
  select concat(manufacturer_brand, '|', coalesce(category_normalised, ''), '|', cast(cast(size_value as int) as varchar), '|', size_unit, '|', cast(pack_count as varchar)) as family_key,
         max(category) filter (where hit) as category, count(distinct id) filter (where hit) as variants_count, count(distinct brand_id) filter (where hit) as brands_count,
         min(price) as min_price, max(price) as max_price, round(avg(price) + 1e-7, 2) as avg_price,
         arg_min(brand, (price, id)) filter (where price is not null) as cheapest_brand,
         arg_min(image_url, id) filter (where image_url <> '') as image_url
  from priced group by {tup}
)
select {", ".join(FAMILY_OUT)} from fam where variants_count >= 2 and brands_count >= 1 {tail}"""


@query(_family_sql())
def families_list(spark, sf_dir):
    return families.families(star_views(spark, sf_dir), valid_on=DAY).select(*FAMILY_OUT)


@query(_family_sql(gate="""where exists (select 1 from mem m where m.brand in ('nation_0', 'nation_2') and m.manufacturer_brand = mem.manufacturer_brand
  and m.category_normalised = mem.category_normalised and m.size_value = mem.size_value and m.size_unit = mem.size_unit and m.pack_count = mem.pack_count)"""))
def families_brand_gate(spark, sf_dir):
    return families.families(star_views(spark, sf_dir), valid_on=DAY, brand="nation_0,nation_2").select(*FAMILY_OUT)


@query(_family_sql("manufacturer_brand like '%#1%' or category_normalised like '%#1%' or normalized_name like '%#1%'"))
def families_q_shrinks(spark, sf_dir):
    return families.families(star_views(spark, sf_dir), valid_on=DAY, q="#1").select(*FAMILY_OUT)


@query(_family_sql(tail="order by min_price asc nulls last, variants_count desc, family_key limit 50"))
def families_price_sort(spark, sf_dir):
    return families.family_page(star_views(spark, sf_dir), sort="min_price", dir="asc", valid_on=DAY).select(*FAMILY_OUT)


@query(_family_sql(tail="order by variants_count desc, brands_count desc, family_key limit 50"))
def families_count_sort(spark, sf_dir):
    return families.family_page(star_views(spark, sf_dir), valid_on=DAY).select(*FAMILY_OUT)


KEY = "brand#13|economy|5|ml|1"


@query(f"""
, latest as (
  select o.product_id, o.id, o.price from v_offers o where o.id in (select max(id) from v_offers group by product_id)
    and (o.valid_from is null or o.valid_from <= date '{DAY}') and (o.valid_to is null or o.valid_to >= date '{DAY}')
), priced as (
  select p.id, coalesce(nullif(p.variant_descriptor, ''), '—') as variant, b.slug as brand, l.id as offer_id, cast(l.price as double) as price
  from v_products p join v_brands b on b.id = p.brand_id left join latest l on l.product_id = p.id
  where b.active and manufacturer_brand = 'brand#13' and category_normalised = 'economy' and size_value = 5 and size_unit = 'ml' and pack_count = 1
)
select variant, min(price) over w as min_price, max(price) over w as max_price,
       cast(row_number() over (partition by variant order by price asc nulls last, id) - 1 as int) as position, id as product_id, brand, price, cast(offer_id as varchar) as offer_id
from priced window w as (partition by variant)""")
def family_detail_variants(spark, sf_dir):
    return families.family_variants(star_views(spark, sf_dir), KEY, DAY).withColumn("offer_id", F.col("offer_id").cast("string"))


@query("""
select count(distinct manufacturer_brand || '|' || category_normalised || '|' || cast(size_value as varchar) || '|' || size_unit || '|' || cast(pack_count as varchar)) as families from v_products""")
def distinct_families_nonnull(spark, sf_dir):
    return families.distinct_families(star_views(spark, sf_dir).products)


PRICING = """
, now as (select o.* from v_offers o where o.id in (select max(id) from v_offers group by product_id) and price is not null),
pricing as (
  select p.canonical_product_id, min(cast(o.price as double)) as min_price, max(cast(o.price as double)) as max_price,
         round(avg(cast(o.price as double)) + 1e-7, 2) as avg_price, arg_min(b.slug, (o.price, -o.id)) as cheapest_brand
  from now o join v_products p on p.id = o.product_id join v_brands b on b.id = p.brand_id where p.canonical_product_id is not null group by 1
), member as (
  select canonical_product_id, count(*) as members_count, count(distinct brand_id) as brands_count,
         arg_min(name, id) filter (where name <> '') as display_name, arg_min(image_url, id) filter (where image_url <> '') as image_url
  from v_products where canonical_product_id is not null group by 1
)"""


@query(PRICING + " select * from member left join pricing using (canonical_product_id) where brands_count >= 2")
def canonical_list_pricing(spark, sf_dir):
    return canonical.canonicals(star_views(spark, sf_dir))


@query(PRICING + " select * from member left join pricing using (canonical_product_id) where brands_count >= 2 order by brands_count desc, members_count desc, canonical_product_id limit 50")
def canonical_page(spark, sf_dir):
    return canonical.canonical_page(star_views(spark, sf_dir))


@query(PRICING + """ select * from member left join pricing using (canonical_product_id) where brands_count >= 2
  and canonical_product_id in (select canonical_product_id from v_products p join v_brands b on b.id = p.brand_id where b.slug in ('nation_1', 'nation_3'))""")
def canonical_brand_gate(spark, sf_dir):
    return canonical.canonicals(star_views(spark, sf_dir), brand="nation_1,nation_3,0")


@query(f"""
, now as (
  select o.* from v_offers o where o.id in (select max(id) from v_offers group by product_id)
    and (o.valid_from is null or o.valid_from <= date '{DAY}') and (o.valid_to is null or o.valid_to >= date '{DAY}')
)
select p.canonical_product_id, round(max(cast(o.price as double)) over w - min(cast(o.price as double)) over w, 2) as savings,
       cast(row_number() over (partition by p.canonical_product_id order by cast(o.price as double) asc nulls last, o.id) as int) as position,
       o.id as offer_id, o.product_id, b.slug as brand, cast(o.price as double) as price
from now o join v_products p on p.id = o.product_id join v_brands b on b.id = p.brand_id where p.canonical_product_id is not null
window w as (partition by p.canonical_product_id)""")
def canonical_detail_valid(spark, sf_dir):
    return canonical.comparison(star_views(spark, sf_dir), DAY)


@query(PRICING.split("pricing as")[0].rstrip().rstrip(",") + ", member as" + PRICING.split("member as")[1] + " select * from member")
def canonical_membership_counts(spark, sf_dir):
    return canonical.membership(star_views(spark, sf_dir).products)


@query("select distinct p.category from v_products p join v_brands b on b.id = p.brand_id where b.active and category is not null and category <> ''")
def categories_distinct(spark, sf_dir):
    return offers.categories(star_views(spark, sf_dir))


@query("select id, name, slug from v_brands where active")
def brands_active(spark, sf_dir):
    return offers.active_brands(star_views(spark, sf_dir))


@query("select id, slug from v_brands b where active and not exists (select 1 from v_products p where p.brand_id = b.id and p.canonical_product_id = 8)")
def absent_brands_anti(spark, sf_dir):
    return offers.absent_brands(star_views(spark, sf_dir), 8)


@query("select crawl_run_id, count(*) as offers_persisted from v_offers group by 1")
def run_offer_counts(spark, sf_dir):
    return offers.run_counts(star_views(spark, sf_dir))


@query("select brand_id, arg_max(id, (finished_at, id)) as run_id from v_runs where status = 'success' group by 1")
def latest_successful_runs(spark, sf_dir):
    return offers.latest_successful_runs(star_views(spark, sf_dir)).drop("finished_at")


SIGNAL = "(coalesce(discount_pct, 0) > 0 or length(trim(coalesce(promo_label, ''))) > 0 or coalesce(original_price > price, false))"


@query(f"select id, product_id, price from v_offers where {SIGNAL}")
def promo_signal_accept(spark, sf_dir):
    return writes.without_leaks(star_views(spark, sf_dir).offers).select("id", "product_id", "price")


@query(f"select id, product_id, price from v_offers where not {SIGNAL}")
def promo_signal_reject(spark, sf_dir):
    return star_views(spark, sf_dir).offers.where(~core.promo_signal()).select("id", "product_id", "price")


INCOMING = """
select p_partkey as seq, (p_partkey + case when p_partkey % 11 = 0 then 1 else 0 end) % 25 as brand_id,
       case when p_partkey % 4 = 0 then null when p_partkey % 8 = 1 then '' when p_partkey % 8 < 4 then concat('x', cast(p_partkey % 75 as varchar(20))) else cast(p_partkey as varchar(20)) end as external_id,
       case when p_partkey % 3 = 0 then concat(p_brand,' ',p_type,' ',p_name) else substr(p_type, 1, 9) end as name,
       lower(case when p_partkey % 3 = 0 then concat(p_brand,' ',p_type,' ',p_name) else substr(p_type, 1, 9) end) as normalized_name
from part"""


@query(f"""
, incoming as ({INCOMING}),
ext as (select brand_id, external_id, min(id) as ext_id from v_products where external_id is not null group by 1, 2),
nam as (select brand_id, normalized_name, min(id) as name_id from v_products where external_id is null group by 1, 2),
item as (
  select row_number() over (order by seq) as nn, i.seq, i.brand_id, ext_id, name_id, case when i.external_id <> '' then concat_ws('|', 'e', i.brand_id, i.external_id) end as ekey,
         concat_ws('|', 'n', i.brand_id, i.normalized_name) as nkey
  from incoming i left join ext using (brand_id, external_id) left join nam on nam.brand_id = i.brand_id and nam.normalized_name = i.normalized_name),
fold as (
  with recursive step(nn, top, made, seq, brand_id, created, product_id) as (
    select 0::bigint, (select max(id) from v_products), map([]::varchar[], []::bigint[]), 0::bigint, 0::bigint, false, 0::bigint
    union all
    select nn, case when hit is null then top + 1 else top end, case when hit is null then map_concat(made, map([coalesce(ekey, nkey)], [top + 1])) else made end, seq, brand_id, hit is null, coalesce(hit, top + 1)
    from (select i.*, s.top, s.made, coalesce(ext_id, made[ekey], name_id, made[nkey]) as hit from step s join item i on i.nn = s.nn + 1) x)
  select * from step where nn > 0)
select seq, brand_id, created, product_id from fold""")
def product_resolve_merge(spark, sf_dir):
    t = star_views(spark, sf_dir)
    incoming = spark.sql(INCOMING.replace("from part", "from {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))
    return writes.resolve_products(t.products, incoming).select("seq", "brand_id", "created", "product_id")


PROPOSALS = """
select p_partkey as product_id, p_partkey % 41 + 1 as canonical_id, cast((p_partkey % 7) / 10.0 + 0.35 as decimal(4,3)) as confidence, 'rule' as method, p_partkey as seq
from part where p_partkey % 2 = 0 union all
select p_partkey as product_id, p_partkey % 37 + 1 as canonical_id, cast((p_partkey % 5) / 10.0 + 0.4 as decimal(4,3)) as confidence, 'rule' as method, p_partkey + 500000 as seq from part where p_partkey % 6 < 2 union all
select p_partkey as product_id, 200 + p_partkey % 89 as canonical_id, cast((p_partkey % 3) / 10.0 + 0.5 as decimal(4,3)) as confidence, 'rule' as method, p_partkey + 700000 as seq from part where p_partkey % 4 = 0 union all
select p_partkey + 1000000 as product_id, 1 as canonical_id, cast(0.9 as decimal(4,3)) as confidence, 'rule' as method, p_partkey + 1000000 as seq from part where p_partkey % 97 = 0"""
OLD_CONFIDENCE = "case when p_partkey % 3 = 0 then null else cast(0.6 as decimal(4,3)) end"


def _arbitrated(spark, sf_dir) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    t = star_views(spark, sf_dir)
    products = t.products.withColumn("canonical_match_confidence", F.when(F.col("id") % 3 == 0, None).otherwise(F.lit(0.6)).cast("decimal(4,3)"))
    return writes.arbitrate(products, spark.sql(PROPOSALS.replace("from part", "from {part}"), part=part))


ARBITRATED = f"""
, proposal as ({PROPOSALS}),
conf as (select p_partkey as id, {OLD_CONFIDENCE} as old_confidence from part),
now as (select p.id as product_id, brand_id, canonical_product_id as old_id, old_confidence from v_products p join conf using (id)),
slots as (select old_id as canonical_id, brand_id, count(*) as n from now where old_id is not null group by 1, 2),
item as (
  select row_number() over (order by r.seq) as nn, r.seq, r.product_id, r.canonical_id, r.confidence::double as confidence, w.brand_id, w.old_id, w.old_confidence::double as old_confidence, coalesce(slots.n, 0) as n
  from proposal r left join now w using (product_id) left join slots on slots.canonical_id = r.canonical_id and slots.brand_id = w.brand_id),
done as (
  with recursive step(nn, moved, slot, seq, product_id, canonical_id, outcome) as (
    select 0::bigint, map([]::bigint[], []::struct(id bigint, confidence double)[]), map([]::varchar[], []::bigint[]), 0::bigint, 0::bigint, 0::bigint, ''
    union all
    select nn, case when outcome = 'assigned' then map_concat(moved, map([product_id], [{{'id': canonical_id, 'confidence': confidence}}])) else moved end,
           case when outcome = 'assigned' and has is distinct from canonical_id then map_concat(slot, map([here] || case when has is null then [] else [gone] end, [coalesce(slot[here], 0) + 1] || case when has is null then [] else [coalesce(slot[gone], 0) - 1] end)) else slot end,
           seq, product_id, canonical_id, outcome
    from (select *, case when brand_id is null then 'unknown_product' when has is not null and sure > confidence then 'kept_higher'
                         when n + coalesce(slot[here], 0) - case when has = canonical_id then 1 else 0 end > 0 then 'duplicate_brand_skipped' else 'assigned' end as outcome
          from (select i.*, s.moved, s.slot, concat_ws('|', i.canonical_id, i.brand_id) as here, concat_ws('|', case when s.moved[i.product_id] is null then old_id else s.moved[i.product_id].id end, i.brand_id) as gone,
                       case when s.moved[i.product_id] is null then old_id else s.moved[i.product_id].id end as has,
                       case when s.moved[i.product_id] is null then old_confidence else s.moved[i.product_id].confidence end as sure
                from step s join item i on i.nn = s.nn + 1) x) y)
  select seq, product_id, canonical_id, outcome from step where nn > 0)"""


@query(ARBITRATED + " select seq, product_id, canonical_id, outcome from done")
def arbitrated_assignments(spark, sf_dir):
    return _arbitrated(spark, sf_dir).select("seq", "product_id", "canonical_id", "outcome")


@query(ARBITRATED + " select outcome, count(*) as n from done group by 1")
def one_per_chain_guard(spark, sf_dir):
    return _arbitrated(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))


SIGNS = 6
PAIRS_SQL = f"""
v as (select vec_id, embedding::double[] as e, label || ' ' || {" || ".join(f"case when embedding[{i + 1}] > 0 then '+' else '-' end" for i in range(SIGNS))} as block from embeddings),
inside as (select *, count(*) over (partition by block) as n from v),
pairs as (
  select a.vec_id as a, b.vec_id as b, round(list_dot_product(a.e, b.e), 3) + 0.0 as cosine from inside a join inside b on a.block = b.block and a.n <= 8 and a.vec_id < b.vec_id),
routed as (select *, case when cosine >= 0.2 then 'embedding_merged' when cosine >= 0.1 then 'review' else 'embedding_dropped' end as route from pairs)"""


def _vector_pairs(spark, sf_dir) -> DataFrame:
    """The block of a vector is its label and the signs of its first parts, and blocks over the cap aren't compared; low thresholds, for the vectors of these tables lie far apart."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    signs = [F.when(F.col("embedding")[i] > 0, "+").otherwise("-") for i in range(SIGNS)]
    rows = v.select(F.col("vec_id").alias("product_id"), F.concat(F.col("label").cast("string"), F.lit(" "), *signs).alias("manufacturer"), F.lit(1).alias("size"), F.lit(1).alias("pack"), "embedding")
    pairs = resolve.block_pairs(rows).select(F.col("a.product_id").alias("a"), F.col("b.product_id").alias("b"), F.round(numbers.cosine(F.col("a.embedding"), F.col("b.embedding")), 3).alias("cosine"))
    config = resolve.MatchConfig(auto_merge_cosine=0.2, review_cosine=0.1)
    open_ = F.struct(F.lit(False).alias("same"), F.lit(0.6).alias("confidence"))
    return pairs.withColumn("route", resolve.route(open_, F.col("cosine"), config))


@query("with " + PAIRS_SQL + " select a, b, cosine, route from routed")
def pair_cosine_routing(spark, sf_dir):
    return _vector_pairs(spark, sf_dir)


@query("with " + PAIRS_SQL + """ select count(*) as pairs_evaluated, count(*) filter (where route = 'rule_merged') as pairs_rule_merged, count(*) filter (where route = 'rule_dropped') as pairs_rule_dropped,
  count(*) filter (where route = 'embedding_merged') as pairs_embedding_merged, count(*) filter (where route = 'review') as pairs_review, count(*) filter (where route = 'embedding_dropped') as pairs_embedding_dropped from routed""")
def pairs_statistics(spark, sf_dir):
    return resolve.pair_statistics(_vector_pairs(spark, sf_dir))


@query("""
with recursive edge as (
  select vec_id as a, vec_id + 10 as b from embeddings where vec_id % 3 <> 0 and vec_id % 70 < 60 and vec_id + 10 in (select vec_id from embeddings)),
both_ways as (select a, b from edge union select b, a from edge),
reach(id, b) as (select vec_id, vec_id from embeddings union select r.id, e.b from reach r join both_ways e on e.a = r.b)
select id, min(b) as component from reach group by id""")
def match_components(spark, sf_dir):
    block = F.concat_ws("|", F.floor(F.col("id") / 70), F.col("id") % 10)
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id")).withColumn("block", block)
    edges = v.where("id % 3 <> 0 and id % 70 < 60").select(F.col("id").alias("a"), (F.col("id") + 10).alias("b"), "block")
    return resolve.components(v, edges.join(v.select(F.col("id").alias("b")), "b", "left_semi"))


@query(r"""
with t as (select doc_id, source || ' ' || lang || ' ' || length(text) // 10 as block, list_sort(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) >= 5))) as tokens from documents),
inside as (select *, count(*) over (partition by block) as n from t where block is not null),
pairs as (select a.doc_id as a, b.doc_id as b, a.tokens as ta, b.tokens as tb from inside a join inside b on a.block = b.block and a.n <= 8 and a.doc_id < b.doc_id),
j as (select a, b, len(ta) as na, len(tb) as nb, len(list_intersect(ta, tb)) as both_n from pairs),
s as (select *, case when na + nb - both_n > 0 then both_n / (na + nb - both_n) else 0 end as jac from j)
select a, b, case when na = 0 and nb = 0 then true when na > 0 and nb > 0 and both_n = 0 then false else jac >= 0.5 end as same,
  round(case when na = 0 and nb = 0 then 1 when na > 0 and nb > 0 and both_n = 0 then 1 when jac >= 0.5 then 0.9 + 0.1 * jac when jac >= 0.25 then 0.6 else 0.95 end, 6) as confidence
from s""")
def jaccard_rule_decisions(spark, sf_dir):
    """Documents of one source, language and about one length are a block, as products of one maker, size and pack are; whole texts."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 5)))
    block = F.concat("source", F.lit(" "), "lang", F.lit(" "), F.floor(F.length("text") / 10).cast("string"))
    rows = d.select(F.col("doc_id").alias("product_id"), words.alias("variant_tokens"), block.alias("manufacturer"), F.lit(1).alias("size"), F.lit(1).alias("pack"))
    pairs = resolve.block_pairs(rows).withColumn("d", resolve.decision())
    return pairs.select(F.col("a.product_id").alias("a"), F.col("b.product_id").alias("b"), F.col("d.same").alias("same"), F.round("d.confidence", 6).alias("confidence"))


@query("select doc_id, md5(replace(trim(regexp_replace(strip_accents(lower(text)), '[\\s]+', ' ', 'g')), 'ς', 'σ')) as normalized from documents")
def normalize_text(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(F.translate(text.normalize(F.col("text")), "ς", "σ").cast("binary")).alias("normalized"))


@query("""
with t as (select doc_id, list_sort(list_distinct(list_filter(string_split_regex(strip_accents(lower(text)), '[^a-z0-9]+'), lambda w: length(w) >= 2 and not regexp_full_match(w, '[0-9]+')))) as tokens from documents)
select doc_id, coalesce(nullif(array_to_string(tokens[1:4], '-'), ''), 'x') as slug from t""")
def token_slug(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = F.filter(F.split(text.normalize(F.col("text")), "[^a-z0-9]+"), lambda w: (F.length(w) >= 2) & ~w.rlike("^[0-9]+$"))
    return d.select("doc_id", text.variant_slug(F.array_sort(F.array_distinct(words))).alias("slug"))


@query(r"""
with t as (select doc_id, trim(regexp_replace(strip_accents(lower(text)), '[\s]+', ' ', 'g')) as s from documents),
u as (select doc_id, regexp_replace(regexp_replace(s, '([0-9]+)[.,]([0-9]+)', '\1.\2', 'g'), '([0-9])\s*(ml|l|lt|gr|g|kg|pcs|pack)\b', '\1\2', 'g') as s from t)
select doc_id, md5(trim(regexp_replace(regexp_replace(replace(replace(s, 'lt', 'l'), 'gr', 'g'), '[.,/()\[\]+*''"`!?]', ' ', 'g'), '\s+', ' ', 'g'))) as key from u""")
def match_key(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", F.md5(text.match_key(F.col("text")).cast("binary")).alias("key"))


@query(r"""
select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) as title, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) as links,
       list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1)) is not null as has_links from pages""")
def html_title_links(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    links = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return p.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.size(links).alias("links"), F.array_distinct(links).isNotNull().alias("has_links"))


@query("""
with a as (select page_id, unnest(regexp_extract_all(html, '<html lang="([^"]*)"', 1)) as lang, unnest(regexp_extract_all(html, '<!-- ad ([0-9]+) -->', 1)) as ad from pages)
select page_id, lang, cast(ad as int) as ad from a where ad is not null""")
def page_json_attrs(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = F.explode(F.arrays_zip(F.regexp_extract_all("html", F.lit('<html lang="([^"]*)"'), F.lit(1)).alias("lang"), F.regexp_extract_all("html", F.lit("<!-- ad ([0-9]+) -->"), F.lit(1)).alias("ad")))
    return p.select("page_id", got.alias("x")).select("page_id", "x.lang", F.col("x.ad").try_cast("int").alias("ad")).where("ad is not null")


@query("""
with e as (select user_id, event_id, value < 50 as low, row_number() over (partition by user_id order by ts, event_id) as n from events),
g as (select *, n - row_number() over (partition by user_id, low order by n) as island from e)
select user_id, min(event_id) as first_event, count(*) as streak from g where low group by user_id, island having count(*) >= 2""")
def event_streaks(spark, sf_dir):
    from .plans.paging import streaks

    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts", (F.col("value") < 50).alias("low"))
    return streaks(e, ["user_id"], ["ts", "event_id"], "low").where("streak >= 2").select("user_id", F.col("first_id").alias("first_event"), "streak")


@query(r"""
with t as (select doc_id, regexp_extract(text, '([0-9]{1,3}(?:[.,\s][0-9]{3})+(?:[.,][0-9]{1,2})?|[0-9]+(?:[.,][0-9]{1,2})?)', 1) as num from documents),
u as (select doc_id, case when contains(num, '.') and contains(num, ',') then case when length(num) - strpos(reverse(num), ',') > length(num) - strpos(reverse(num), '.') then replace(replace(num, '.', ''), ',', '.') else replace(num, ',', '') end
  else replace(num, ',', '.') end as s from t)
select doc_id, cast(try_cast(replace(nullif(s, ''), ' ', '') as decimal(18,3)) as varchar) as price from u""")
def price_parse(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", numbers.parse_price(F.col("text")).cast("string").alias("price"))


@query(r"""
with t as (select doc_id, try_cast(regexp_extract(text, '([0-9]{1,3})\s*%', 1) as int) as n from documents) select doc_id, cast(case when n between 0 and 100 then n end as double) as pct from t""")
def percent_parse(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", numbers.parse_percent(F.col("text")).cast("double").alias("pct"))


def _named(spark, sf_dir: str, name: str) -> DataFrame:
    """Parts under a name made of their columns by the expression, which runs in both engines."""
    return spark.sql(f"select p_partkey as id, {name} as name from {{part}}", part=spark.read.parquet(f"{sf_dir}/part.parquet"))


SIZED = """case p_partkey % 6 when 0 then concat(p_name, ' ', p_size, 'ml') when 1 then concat(p_name, ' ', p_size, ',5 Kg') when 2 then concat(p_name, ' 2x', p_size, ' γρ.')
  when 3 then concat(p_name, ' 500g ', p_size, ' lt') when 4 then concat(p_name, ' No', p_size, ' 30ml') else p_name end"""


@query("""
select p_partkey as id, case when p_partkey % 6 < 5 then p_size + case when p_partkey % 6 = 1 then 0.5 else 0 end end::double as size_value,
       case p_partkey % 6 when 0 then 'ml' when 1 then 'kg' when 2 then 'g' when 3 then 'l' when 4 then 'no' end as size_unit from part""")
def size_extract(spark, sf_dir):
    return _named(spark, sf_dir, SIZED).select("id", text.size(F.col("name")).alias("s")).select("id", F.col("s.value").alias("size_value"), F.col("s.unit").alias("size_unit"))


PACKED = """case p_partkey % 5 when 0 then concat(p_name, ' ', p_size, 'x330ml') when 1 then concat(p_name, ' ', p_size, ' × 1,5L + 2 Δώρο') when 2 then p_name
  when 3 then concat(p_name, ' 6 χ ', p_size, 'g') else concat(p_name, ' x', p_size) end"""


@query("select p_partkey as id, case p_partkey % 5 when 3 then 6 when 0 then case when p_size <= 48 then p_size else 1 end when 1 then case when p_size <= 48 then p_size else 1 end + 2 else 1 end as pack from part")
def pack_extract(spark, sf_dir):
    return _named(spark, sf_dir, PACKED).select("id", text.pack_count(F.col("name")).alias("pack"))


DATED = """case p_partkey % 5 when 0 then concat('έως ', p_size % 28 + 1, ' Μαΐου ', 2020 + p_size % 7) when 1 then concat('από ', p_size % 28 + 1, '.', p_size % 12 + 1) when 2 then concat(p_size % 28 + 1, '/', p_size % 12 + 1, '/', 2020 + p_size % 7)
  when 3 then concat(p_size % 28 + 1, '-', p_size % 12 + 1, '-26') else p_name end"""


@query("""
select p_partkey as id, case p_partkey % 5 when 4 then null else cast(make_date(case when p_partkey % 5 in (0, 2) then 2020 + p_size % 7 else 2026 end, case when p_partkey % 5 = 0 then 5 else p_size % 12 + 1 end, p_size % 28 + 1) as varchar) end as day from part""")
def greek_date_parse(spark, sf_dir):
    return _named(spark, sf_dir, DATED).select("id", numbers.parse_date(F.col("name"), 2026).cast("string").alias("day"))


#: Names that lists use for makers, the maker they stand for, and a store's own label and an unknown name, which stand for none.
ALIASES = (("Lacta", "lacta"), ("COCA COLA", "coca-cola"), ("Φάγε", "fage"), ("RedBull", "red-bull"), ("Kri-Kri", "kri-kri"), ("Somebody", None), ("My Gusto", None), ("Δωδώνη", "dodoni"))
_ALIAS = "case p_partkey % 8 " + " ".join(f"when {i} then '{a}'" for i, (a, _) in enumerate(ALIASES)) + " end"
_MAKER = "case p_partkey % 8 " + " ".join(f"when {i} then '{m}'" for i, (_, m) in enumerate(ALIASES) if m) + " end"


@query(f"""
, n as (select p_partkey as id, {_MAKER} as manufacturer, p_size, list_sort(list_distinct(list_filter(string_split(lower(case p_partkey % 8 when 5 then 'somebody ' when 6 then 'my gusto ' else '' end || p_name), ' '), lambda w: w <> 'new'))) as t from part)
select id, manufacturer, p_size::double as size_value, 'ml' as size_unit, 6 as pack, array_to_string(t, ' ') as tokens, manufacturer || ':' || array_to_string(t[1:4], '-') || ':' || p_size || 'ml:6' as canonical_key from n""".replace(", n as", "with n as"))
def product_features(spark, sf_dir):
    rows = text.with_features(_named(spark, sf_dir, f"concat({_ALIAS}, ' ', p_name, ' 6x', p_size, 'ml')"))
    return rows.select("id", "manufacturer", F.col("size.value").alias("size_value"), F.col("size.unit").alias("size_unit"), "pack", F.array_join("variant_tokens", " ").alias("tokens"), "canonical_key")


#: Five chains list each product; the fourth adds a word to its name, the fifth sells another variant. Sizes tell products apart.
LISTED = "concat(case floor(p_partkey / 5) % 2 when 0 then 'Lacta' else 'Δωδώνη' end, case p_partkey % 5 when 3 then ' Dark Extra Milk ' when 4 then ' White ' else ' Dark Milk ' end, cast(floor(p_partkey / 5) as int) + 1, 'g')"


@query("""
with g as (select p_partkey // 5 as g, p_partkey // 5 + 1 as size, case p_partkey // 5 % 2 when 0 then 'lacta' else 'dodoni' end as maker, case p_partkey // 5 % 2 when 0 then 'Lacta' else 'Δωδώνη' end as alias, count(*) as n from part group by 1, 2, 3, 4),
rows as (
  select maker || ':dark-extra-milk:' || size || 'g:1' as canonical_key, maker as manufacturer_brand, 'Dark Milk' as variant_descriptor, alias || ' Dark Extra Milk ' || size || 'g' as display_name, 4 as members_count, 4 as brands_count, size from g
  union all select maker || ':white:' || size || 'g:1', maker, 'White', alias || ' White ' || size || 'g', 1, 1, size from g)
select canonical_key, manufacturer_brand, size::double as size_value, variant_descriptor, display_name, members_count, brands_count::bigint as brands_count, (row_number() over (order by canonical_key) - 1) // 200 as batch from rows""")
def entity_groups(spark, sf_dir):
    """The whole resolution, from names to batches: features, blocks, rules, components and payloads."""
    names = _named(spark, sf_dir, LISTED)
    products = names.select(F.col("id").alias("product_id"), F.concat(F.lit("c"), (F.col("id") % 5).cast("string")).alias("brand_slug"), "name", F.lit("Sweets").alias("category"))
    rows = resolve.canonicalise(products, include_singletons=True)["payload"]
    return rows.select("canonical_key", "manufacturer_brand", "size_value", "variant_descriptor", "display_name", F.size("members").alias("members_count"), "brands_count", "batch")


@query("select promo_label as label, count(*) as offers, min(cast(price as double)) as least from v_offers group by 1 order by offers desc, label nulls first limit 20")
def promo_label_histogram(spark, sf_dir):
    return offers.label_histogram(star_views(spark, sf_dir).offers)


@query("select count(*) as products, count(manufacturer_brand) as with_manufacturer, count(size_value) as with_size, count(*) filter (where pack_count >= 2) as multi_packs, count(canonical_product_id) as with_key from v_products")
def enrichment_coverage(spark, sf_dir):
    p = star_views(spark, sf_dir).products
    return resolve.coverage(p.select(F.col("manufacturer_brand").alias("manufacturer"), F.col("size_value").alias("size"), F.col("pack_count").alias("pack"), F.col("canonical_product_id").alias("canonical_key")))


@query("""
with k as (select replace(replace(lower(p_name), 'lt', 'l'), 'gr', 'g') || ' ' || p_size || 'ml' as key, p_partkey % 25 as brand_id from part)
select key, count(*) as products, count(distinct brand_id) as chains from k group by key having count(distinct brand_id) >= 2 order by chains desc, products desc, key limit 40""")
def match_key_clusters(spark, sf_dir):
    """Names that differ in letter case, accents and marks share the aggressive key."""
    written = "concat(case when p_partkey % 2 = 0 then upper(p_name) else p_name end, case when p_partkey % 3 = 0 then ' (' else '  ' end, p_size, case when p_partkey % 3 = 0 then ' ML)' else 'ml!' end)"
    rows = _named(spark, sf_dir, written).select(text.match_key(F.col("name")).alias("key"), (F.col("id") % 25).alias("brand_id"))
    return resolve.key_clusters(rows, "key", "brand_id")


#: One row a part: its price ``c`` and the price ``o`` before, in cents, and the place on its page.
SHELF = "select cast(p_partkey as varchar(20)) as k, p_name as name, 1000 + p_partkey * 7 % 900 as c, 1000 + p_partkey * 7 % 900 + p_size % 4 * 100 as o, p_size as n, floor(p_partkey / 20) as page, cast(p_partkey % 20 as int) as position from part"
#: What each chain's offers are, as SQL over SHELF: (price in cents, original in cents, percent, label, type, condition).
_PCT = "case when o > c then cast(round_even((o - c) * 100.0 / o, 0) as int) end"
SOURCES = {
    "ab": ("case when n % 3 = 0 then c else o end", "case when n % 3 = 0 and o > c then o end", f"case when n % 3 = 0 then {_PCT} end", "case when n % 3 = 1 then '1+1 δώρο' end", "case when n % 3 = 0 then 'strikethrough' else 'bxgy_free' end", "n % 3 < 2"),
    "lidl": ("c", "case when o > c then o end", "case when n % 3 = 0 then n end", "case when n % 3 = 0 then '−' || n || '%' end", "case when n % 3 = 0 then 'strikethrough' end", "n % 3 = 0 or o > c"),
    "masoutis": ("c", "case when o > c then o end", "case when n % 3 = 0 then n end", "case when n % 3 = 0 then '-' || n || '%' end", "case when n % 3 = 0 then 'strikethrough' end", "n % 3 = 0 or o > c"),
    "my-market": ("c", "case when o > c then o end", _PCT, "cast(null as varchar)", "case when o > c then 'strikethrough' end", "o > c"),
    "sklavenitis": ("c", "case when o > c then o end", "n", "'-' || n || '%'", "'strikethrough'", "n % 5 > 0"),
}


def _source_sql(chain: str) -> str:
    price, original, pct, label, kind, keep = SOURCES[chain]
    return f"""
with shelf as ({SHELF}) select k as external_id, name, cast({price} as double) / 100 as price, cast({original} as double) / 100 as original_price, cast({pct} as double) as discount_pct, {label} as promo_label,
  {kind} as promo_type, day, position from shelf cross join (values ('2026-05-01'), ('2026-05-02')) d(day) where {keep}"""


def crawled_bodies(spark, sf_dir: str, chain: str) -> DataFrame:
    """Responses of the chain's site that list all parts, twenty a page; two crawls of the same pages, one row of them repeated."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    rows = spark.sql(SHELF.replace("from part", "from {part}"), part=part)
    euros = lambda c, point=".": F.concat((F.col(c) / 100).cast("long").cast("string"), F.lit(point), F.lpad((F.col(c) % 100).cast("string"), 2, "0"))
    say = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    k, name, n, third = F.col("k"), F.col("name"), F.col("n").cast("string"), F.col("n") % 3
    quoted = lambda c: F.replace(c, F.lit('"'), F.lit("&quot;"))
    head, between, tail = "<html><body>", "\n", "</body></html>"
    if chain == "ab":
        head, between, tail = '{"data":{"productList":{"products":[', ",", "]}}}"
        promo = F.when(third == 1, '{"promotionType":"Grocery Buy X get Y free","title":"1 + 1 free"}').otherwise("")
        struck = F.when(third == 0, "true").otherwise("false")
        card = say('{"code":"', k, '","name":"', name, '","price":{"value":', euros("o"), ',"showStrikethroughPrice":', struck, ',"discountedPriceFormatted":"', euros("c", ","), ' €"},"potentialPromotions":[', promo, "]}")
    elif chain == "lidl":
        pct = F.when(third == 0, say('"', n, '"')).otherwise("null")
        card = say('<div data-grid-data="', quoted(say('{"productId":"', k, '","title":"', name, '","regionsPrices":{"1":{"currentPrice":{"price":', euros("c"), ',"oldPrice":', euros("o"), ',"discount":{"percentageDiscount":', pct, "}}}}}")), '"></div>')
    elif chain == "masoutis":
        head, between, tail = "[", ",", "]"
        card = say('{"Itemcode":"', k, '","ItemDescr":"', name, '","PosPrice":"', euros("c"), '","StartPrice":"', euros("o"), '","Discount":"', F.when(third == 0, say("-", n, "%")).otherwise(""), '"}')
    elif chain == "my-market":
        old = F.when(F.col("o") > F.col("c"), say('<span class="diagonal-line">', euros("o", ","), "€</span>")).otherwise("")
        card = say('<article class="product" data-id="', k, '"><a href="/p/', k, '">', name, "</a>", old, '<span class="price-whole">', (F.col("c") / 100).cast("long").cast("string"), '</span><span class="price-fraction">', (F.col("c") % 100).cast("string"), "</span></article>")
    else:
        badge = F.when(F.col("n") % 5 > 0, say('<span class="badge">-', n, "%</span>")).otherwise("")
        card = say("<div data-plugin-product='", '{"sku":"', k, '","name":"', name, '","price":', euros("c"), "}'>", badge, '<span class="deleted">', euros("o", ","), " €</span></div>")
    pages = rows.select("page", "position", card.alias("card")).groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "card"))), lambda x: x["card"]).alias("cards"))
    days = F.explode(F.array(*[F.lit(d).cast("timestamp") for d in ("2026-05-01", "2026-05-02")]))
    bodies = pages.select(F.concat(F.lit(head), F.array_join("cards", between), F.lit(tail)).alias("body"), days.alias("scraped_at"))
    if chain not in ("ab", "masoutis"):  # sources that keep one item of an id and page
        bodies = bodies.union(bodies.where(F.col("scraped_at") == F.lit("2026-05-02").cast("timestamp")))
    return bodies


def _crawled(spark, sf_dir: str, chain: str) -> DataFrame:
    from .sources import chains

    got = chains.PARSERS[chain](crawled_bodies(spark, sf_dir, chain))
    numbers_ = [F.col(c).cast("double").alias(c) for c in ("price", "original_price", "discount_pct")]
    return got.select("external_id", "name", *numbers_, "promo_label", "promo_type", F.date_format("scraped_at", "yyyy-MM-dd").alias("day"), F.col("position").cast("int").alias("position"))


def _source(chain: str) -> None:
    def run(spark, sf_dir):
        return _crawled(spark, sf_dir, chain)

    run.__name__ = f"source_{chain.replace('-', '')}"
    query(_source_sql(chain))(run)


for _chain in SOURCES:
    _source(_chain)


from . import queries_functions, queries_writes  # noqa: E402  they register more of them

__all__ = ["QUERIES", "SQL", "queries_functions", "queries_writes"]
