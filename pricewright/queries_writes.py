"""Registered queries of the write operators, the resolution's parts and the chains' promotion reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import resolve, writes
from .queries import LISTED, _named, crawled_bodies
from .registry import query
from .sources import chains, sinks
from .sources.retail import star_views

#: Items of a crawl with one mistake or another, by the part's number.
ITEMS = """
select p_partkey as seq, case when p_partkey % 11 = 0 then ' ' else p_name end as name, cast(case when p_partkey % 13 = 0 then null when p_partkey % 17 = 0 then -1 else p_size end as decimal(10,2)) as price,
  cast(case when p_partkey % 5 < 3 then p_size + 1 when p_partkey % 19 = 0 then -2 end as decimal(10,2)) as original_price, cast(case when p_partkey % 7 = 0 then p_partkey % 130 end as int) as discount_pct,
  case when p_partkey % 9 = 0 then ' ' when p_partkey % 10 = 0 then 'x' end as promo_label, case when p_partkey % 23 = 0 then 'odd' else 'strikethrough' end as promo_type, case when p_partkey % 29 = 0 then 'EURO' else 'EUR' end as currency,
  cast(date '2026-05-10' as date) as valid_from, case when p_partkey % 31 = 0 then cast(date '2026-05-01' as date) end as valid_to, case when p_partkey % 37 > 0 then cast('2026-05-01 00:00:00' as timestamp) end as scraped_at
from part"""


def _parts(spark, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace("from part", "from {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


@query(f"""
with i as ({ITEMS})
select seq, concat_ws('; ', case when trim(name) = '' then 'name is required' end, case when price is null then 'price is required' end, case when price < 0 then 'price is negative' end, case when original_price < 0 then 'original_price is negative' end,
  case when discount_pct not between 0 and 100 then 'discount_pct is 0 to 100' end, case when promo_type = 'odd' then 'promo_type is unknown' end, case when length(currency) <> 3 then 'currency has three letters' end,
  case when scraped_at is null then 'scraped_at is required' end, case when valid_to < valid_from then 'valid_to is before valid_from' end,
  case when not (coalesce(discount_pct > 0, false) or coalesce(trim(promo_label) <> '', false) or coalesce(original_price > price, false)) then 'no sign of a promotion' end) as errors from i""")
def offer_validation(spark, sf_dir):
    good, bad = writes.split_offers(_parts(spark, sf_dir, ITEMS))
    return bad.select("seq", F.array_join("errors", "; ").alias("errors")).union(good.select("seq", F.lit("")))


GROUPINGS = "select p_partkey as id, case when p_partkey % 5 = 0 then '' else p_name end as canonical_key, p_partkey % 210 as n, cast((p_partkey % 12) / 10.0 as double) as confidence, case when p_partkey % 7 = 0 then 'guess' else 'rule' end as match_method from part"


@query(f"""
with g as ({GROUPINGS})
select id, concat_ws('; ', case when canonical_key = '' then 'canonical_key is required' end, case when n not between 1 and 200 then 'members are 1 to 200' end, case when n > 0 and confidence > 1 then 'confidence is 0 to 1' end,
  case when n > 0 and match_method = 'guess' then 'match_method is unknown' end) as errors from g""")
def grouping_validation(spark, sf_dir):
    rows = _parts(spark, sf_dir, GROUPINGS)
    member = F.struct(F.col("id").alias("product_id"), "confidence", "match_method")
    rows = rows.withColumn("members", F.when(F.col("n") > 0, F.array_repeat(member, F.col("n").cast("int"))).otherwise(F.array().cast(rows.select(F.array(member).alias("m")).schema["m"].dataType)))
    return rows.select("id", F.array_join(writes.grouping_errors(), "; ").alias("errors"))


#: A run of chain 3: names as they are but for every tenth part, whose name is new; every seventh has no price.
RUN = """
select p_partkey as seq, case when p_partkey % 10 = 3 then concat('new ', p_name, ' ', p_partkey) else concat(p_brand,' ',p_type,' ',p_name) end as name, case when p_partkey % 4 > 0 then cast(p_partkey as varchar(20)) end as external_id, 'Sweets' as category,
  cast(case when p_partkey % 7 > 0 then 2 end as decimal(10,2)) as price, cast(3 as decimal(10,2)) as original_price, cast(null as int) as discount_pct, cast(null as varchar(9)) as promo_label, 'strikethrough' as promo_type, 'EUR' as currency,
  cast(null as date) as valid_from, cast(null as date) as valid_to, cast('2026-05-01 00:00:00' as timestamp) as scraped_at
from part where p_partkey % 25 = 3"""


@query("""
, i as (select p_partkey as seq, p_partkey % 10 = 3 as renamed, p_partkey % 4 > 0 as has_ext, p_partkey % 5 = 0 as plain from part where p_partkey % 25 = 3 and p_partkey % 7 > 0),
own as (select id, normalized_name, external_id from v_products where brand_id = 3),
hit as (
  select i.*, p.normalized_name as old_name, (has_ext and not plain) or exists (select 1 from own w where w.external_id is null and not renamed and w.normalized_name = p.normalized_name) as found from i join v_products p on p.id = i.seq),
made as (select distinct case when has_ext then 'e' || seq when renamed then 'r' || seq else 'n' || old_name end as key from hit where not found)
select (select count(*) from hit) as offers_persisted, (select count(*) from made) as products_created, (select count(*) from hit where found) as products_updated, (select count(*) from part where p_partkey % 25 = 3 and p_partkey % 7 = 0) as rejected,
  (select count(*) from v_products) + (select count(*) from made) as products""")
def ingest_result(spark, sf_dir):
    t = star_views(spark, sf_dir)
    none = t.offers.limit(0).withColumns({"promo_type": F.lit(None).cast("string"), "currency": F.lit(None).cast("string")})
    got = writes.ingest(t.products, none, _parts(spark, sf_dir, RUN), (9, 3, "running"))
    counts = got["counts"].join(got["rejected"].agg(F.count("*").alias("rejected"))).join(got["products"].agg(F.count("*").alias("products")))
    return counts.select("offers_persisted", "products_created", "products_updated", "rejected", "products")


@query("select (select max(id) from v_offers) + row_number() over (order by id) as id, id as product_id, 9::bigint as crawl_run_id, 'EUR' as currency from v_products where id % 3 = 0")
def appended_offers(spark, sf_dir):
    t = star_views(spark, sf_dir)
    resolved = t.products.where("id % 3 = 0").select(F.col("id").alias("seq"), F.col("id").alias("product_id"), F.lit(1.0).alias("price"))
    return writes.new_offers(t.offers.withColumn("currency", F.lit("EUR")), resolved, 9).select("id", "product_id", "crawl_run_id", "currency")


#: Canonicals that are there, and those that come: same, changed, with a new image, new ones.
HAVE = "select p_partkey as id, concat('k', p_partkey) as canonical_key, p_name as display_name, p_type as category, case when p_partkey % 4 > 0 then concat('/', p_partkey) end as image_url, 0 as members_count, 0 as brands_count from part where p_partkey % 2 = 0"
COME = "select concat('k', p_partkey) as canonical_key, case when p_partkey % 5 = 0 then concat(p_name, '!') else p_name end as display_name, p_type as category, case when p_partkey % 3 = 0 then concat('/', p_partkey, 'n') end as image_url, p_partkey as seq from part where p_partkey % 6 < 4"


@query(f"""
with h as ({HAVE}), c as ({COME}), n as (select canonical_key, row_number() over (order by seq) as nth from c where canonical_key not in (select canonical_key from h))
select coalesce(h.id, (select max(id) from h) + nth) as id, canonical_key, coalesce(c.display_name, h.display_name) as display_name, coalesce(c.image_url, h.image_url) as image_url,
  case when h.id is null then 'created' when c.seq is null then 'kept' when c.display_name <> h.display_name or coalesce(c.image_url, h.image_url) is distinct from h.image_url then 'updated' else 'same' end as outcome
from h full join c using (canonical_key) left join n using (canonical_key)""")
def canonical_upserts(spark, sf_dir):
    return writes.upsert_canonicals(_parts(spark, sf_dir, HAVE), _parts(spark, sf_dir, COME)).select("id", "canonical_key", "display_name", "image_url", "outcome")


@query(f"""
, h as ({HAVE}), m as (select canonical_product_id as id, count(*) as n, count(distinct brand_id) as b, arg_min(image_url, id) filter (where image_url <> '') as i from v_products where canonical_product_id is not null group by 1)
select h.id, coalesce(n, 0)::int as members_count, coalesce(b, 0)::int as brands_count, coalesce(h.image_url, i) as image_url from h left join m using (id)""")
def refreshed_canonicals(spark, sf_dir):
    from .plans import canonical

    return writes.refresh_canonicals(_parts(spark, sf_dir, HAVE), canonical.membership(star_views(spark, sf_dir).products)).select("id", "members_count", "brands_count", "image_url")


UPDATES = "select id, case when id % 5 = 0 then 'running' when id % 5 = 1 then 'failed' else 'success' end as u, (id % 60)::int as found, case when id % 3 = 0 then (id % 50)::int end as kept from v_runs where id % 4 > 0"


@query(f"""
, u as ({UPDATES}), n as (select crawl_run_id as id, count(*) as n from v_offers group by 1),
j as (select r.id, r.status, u.u, u.found, coalesce(u.kept, n.n, 0) as kept from v_runs r left join u using (id) left join n using (id)),
e as (select *, case when u is null then null when status <> 'running' then 'run has ended' when u not in ('success', 'failed', 'partial') then 'status isn''t final' when kept > found then 'more offers kept than found' end as error from j)
select id, case when u is not null and error is null then u else status end as status, case when u is not null and error is null then kept end::double as kept, error from e""")
def finished_runs(spark, sf_dir):
    t = star_views(spark, sf_dir)
    runs = t.runs.withColumns({"offers_found": F.lit(None).cast("int"), "offers_persisted": F.lit(None).cast("int")})
    n = F.col("id")
    updates = t.runs.where("id % 4 > 0").select("id", F.when(n % 5 == 0, "running").when(n % 5 == 1, "failed").otherwise("success").alias("status"), (n % 60).cast("int").alias("offers_found"), F.when(n % 3 == 0, (n % 50).cast("int")).alias("offers_persisted"))
    return writes.finish_runs(runs, updates, t.offers).select("id", "status", F.col("offers_persisted").cast("double").alias("kept"), "error")


@query("""
select n_nationkey::bigint as id, case when n_nationkey % 3 = 2 then 'unknown brand' when n_nationkey % 5 = 1 then 'brand is not active' end as error from nation""")
def started_runs(spark, sf_dir):
    t = star_views(spark, sf_dir)
    asked = t.brands.select("id", F.when(F.col("id") % 3 == 2, F.concat("slug", F.lit("?"))).otherwise(F.col("slug")).alias("slug"))
    return writes.start_run_errors(t.brands, asked).select("id", "error")


@query("select id, product_id from v_offers where product_id % 10 = 0")
def orphaned_offers(spark, sf_dir):
    t = star_views(spark, sf_dir)
    return writes.orphans(t.offers.select("id", "product_id"), "product_id", t.products.where("id % 10 <> 0"))


@query("""
select p_partkey as id, case p_partkey // 5 % 2 when 0 then 'lacta' else 'dodoni' end as manufacturer_brand, 'sweets' as category_normalised, (p_partkey // 5 + 1)::double as size_value, 'g' as size_unit, 1 as pack_count,
  case p_partkey % 5 when 3 then 'dark-extra-milk' when 4 then 'white' else 'dark-milk' end as variant_descriptor from part""")
def backfilled_products(spark, sf_dir):
    rows = _named(spark, sf_dir, LISTED).withColumn("category", F.lit("Sweets"))
    for c in writes.FEATURES:
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    return writes.backfill(rows).select("id", "manufacturer_brand", "category_normalised", F.col("size_value").cast("double").alias("size_value"), "size_unit", "pack_count", "variant_descriptor")


def _resolved(spark, sf_dir) -> dict[str, DataFrame]:
    names = _named(spark, sf_dir, LISTED)
    products = names.select(F.col("id").alias("product_id"), F.concat(F.lit("c"), (F.col("id") % 5).cast("string")).alias("brand_slug"), "name", F.lit("Sweets").alias("category"))
    angle = F.when(F.col("id") % 5 == 4, F.lit(0.3)).otherwise(F.lit(0.0))
    vectors = names.select(F.col("id").alias("product_id"), F.array(F.cos(angle), F.sin(angle)).alias("vector"))
    return resolve.canonicalise(products, vectors, include_singletons=True)


@query("""
with g as (select count(*) / 5 as n from part)
select 'pairs_evaluated' as name, (10 * n)::bigint as value from g union all select 'pairs_rule_merged', (6 * n)::bigint from g union all select 'pairs_rule_dropped', (4 * n)::bigint from g union all select 'pairs_embedding_merged', 0 union all select 'pairs_review', 0
union all select 'pairs_embedding_dropped', 0 union all select 'joined_by_rule', (3 * n)::bigint from g union all select 'joined_by_vector', 0 union all select 'groups', (2 * n)::bigint from g union all select 'singletons', n::bigint from g union all select 'multi', n::bigint from g
union all select 'two_brands', n::bigint from g union all select 'three_brands', n::bigint from g union all select 'products', (5 * n)::bigint from g union all select 'with_manufacturer', (5 * n)::bigint from g union all select 'with_size', (5 * n)::bigint from g
union all select 'multi_packs', 0 union all select 'with_key', (5 * n)::bigint from g""")
def resolution_counters(spark, sf_dir):
    got = _resolved(spark, sf_dir)
    one = got["statistics"].join(got["joined"]).join(got["summary"]).join(got["coverage"])  # one row each
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("long").alias("value")) for c in one.columns])).alias("x")).select("x.name", "x.value")


@query("""
select case p_partkey // 5 % 2 when 0 then 'lacta' else 'dodoni' end || case when p_partkey % 5 = 4 then ':white:' else ':dark-extra-milk:' end || (p_partkey // 5 + 1) || 'g:1' as canonical_key, p_partkey as product_id, 1.0::double as confidence, 'rule' as match_method from part""")
def payload_members(spark, sf_dir):
    rows = _resolved(spark, sf_dir)["payload"].select("canonical_key", F.explode("members").alias("m"))
    return rows.select("canonical_key", "m.product_id", F.col("m.confidence").cast("double").alias("confidence"), "m.match_method")


#: Two chains that list a product under names with one word in common of three: rules leave it open, vectors decide by the part's number.
OPEN = "concat('Lacta ', case p_partkey % 2 when 0 then 'dark milk ' else 'dark nuts ' end, cast(floor(p_partkey / 2) as int) + 1, 'g')"


def _open_pairs(spark, sf_dir) -> DataFrame:
    from .functions import text

    names = _named(spark, sf_dir, OPEN)
    products = names.select(F.col("id").alias("product_id"), F.concat(F.lit("c"), (F.col("id") % 2).cast("string")).alias("brand_slug"), "name", F.lit("x").alias("category"))
    pair = F.floor(F.col("id") / 2)
    cosine = F.when(pair % 3 == 0, 0.99).when(pair % 3 == 1, 0.9).otherwise(0.5)
    vectors = names.select(F.col("id").alias("product_id"), F.when(F.col("id") % 2 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(cosine, F.sqrt(1 - cosine * cosine))).alias("vector")).where(pair % 7 > 0)
    return resolve.scored_pairs(text.with_features(products), vectors, resolve.CLI)


@query("""
with p as (select p_partkey // 2 as pair from part where p_partkey % 2 = 0)
select 2 * pair as a, 2 * pair + 1 as b, case when pair % 7 = 0 then 'rule_dropped' when pair % 3 = 0 then 'embedding_merged' when pair % 3 = 1 then 'review' else 'embedding_dropped' end as route,
  case when pair % 7 > 0 then case pair % 3 when 0 then 0.99 when 1 then 0.9 else 0.5 end end::double as cosine from p""")
def open_pair_routes(spark, sf_dir):
    return _open_pairs(spark, sf_dir).select(F.col("a.product_id").alias("a"), F.col("b.product_id").alias("b"), "route", F.round("cosine", 6).alias("cosine"))


@query("select 2 * (p_partkey // 2) as a_id, 2 * (p_partkey // 2) + 1 as b_id, 0.9::double as cosine, 0.6::double as rule_confidence from part where p_partkey % 2 = 0 and p_partkey // 2 % 7 > 0 and p_partkey // 2 % 3 = 1")
def review_pairs(spark, sf_dir):
    return resolve.review_queue(_open_pairs(spark, sf_dir))


@query("select lower(p_name) as group_key, p_partkey as product_id, min(p_partkey) over (partition by p_name) as component from part where p_partkey % 6 > 0")
def exact_key_groups(spark, sf_dir):
    rows = _named(spark, sf_dir, "p_name").select(F.col("id").alias("product_id"), F.when(F.col("id") % 6 > 0, F.lower("name")).alias("canonical_key"))
    return resolve.exact_groups(rows).select("group_key", "product_id", "component")


@query("select p_name as canonical_key, (row_number() over (order by p_name) - 1) // 7 as batch from (select distinct p_name from part)")
def push_batches(spark, sf_dir):
    return sinks.batches(_named(spark, sf_dir, "p_name").select(F.col("name").alias("canonical_key")).distinct(), 7)


@query("select 'SHT_TRUE' as family, 2 * count(*) filter (where p_size % 3 = 0) as products from part union all select 'BXGY_FREE', 2 * count(*) filter (where p_size % 3 = 1) from part union all select 'UNKNOWN', 2 * count(*) filter (where p_size % 3 = 2) from part")
def promotion_families(spark, sf_dir):
    return chains.ab_families(crawled_bodies(spark, sf_dir, "ab"))


@query("select 'Grocery Buy X get Y free' as types, 2 * count(*) filter (where p_size % 3 = 1) as products from part union all select '', 2 * count(*) filter (where p_size % 3 <> 1) from part")
def promotion_sets(spark, sf_dir):
    return chains.ab_promotion_sets(crawled_bodies(spark, sf_dir, "ab"))


@query("select 2 * count(*) as products, cast(ceil(2 * count(*) / 50.0) as bigint) as pages, 2 * count(*) filter (where p_size % 3 < 2) as offers from part")
def response_dump(spark, sf_dir):
    """The pages of both crawls as one response, which the chain's source reads as it reads them."""
    whole = chains.ab_dump(crawled_bodies(spark, sf_dir, "ab")).withColumn("scraped_at", F.lit("2026-05-03").cast("timestamp"))
    counts = whole.select(F.get_json_object("body", "$.data.productList.pagination.totalResults").cast("long").alias("products"), F.get_json_object("body", "$.data.productList.pagination.totalPages").cast("long").alias("pages"))
    return counts.join(chains.ab(whole).agg(F.count("*").alias("offers")))


@query("""
with g as (select count(*) / 5 as n, count(*) filter (where p_partkey % 50 = 49) as gone from part)
select (2 * n)::bigint as created, 0::bigint as updated, (4 * n)::bigint - gone as products_assigned, n::bigint as duplicate_brand_skipped, gone as errors, (2 * n)::bigint as canonicals, (4 * n)::bigint - gone as members from g""")
def bulk_upsert_result(spark, sf_dir):
    """The payload of the resolution pushed where there is nothing yet; two of a group's products are of one chain, and some products aren't there."""
    payload = _resolved(spark, sf_dir)["payload"]
    seq = F.array_min(F.transform("members", lambda m: m["product_id"]))
    groupings = payload.select("canonical_key", "manufacturer_brand", "variant_descriptor", "display_name", "category", "members", seq.alias("seq"))
    none = "id long, canonical_key string, manufacturer_brand string, variant_descriptor string, display_name string, category string, image_url string, members_count int, brands_count int"
    products = _named(spark, sf_dir, LISTED).where("id % 50 <> 49").withColumns({"brand_id": F.col("id") % 5 % 3, "image_url": F.lit(""), "canonical_product_id": F.lit(None).cast("long")})
    products = products.withColumns({"canonical_match_confidence": F.lit(None).cast("decimal(4,3)"), "canonical_match_method": F.lit(None).cast("string"), "canonical_matched_at": F.lit(None).cast("timestamp")})
    got = writes.bulk_upsert(spark.createDataFrame([], none), products, groupings, "2026-05-01")
    return got["counts"].join(got["canonicals"].agg(F.count("*").alias("canonicals"), F.sum("members_count").cast("long").alias("members")))
