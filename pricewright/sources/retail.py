"""The retail tables: from their own folders, or as views over the star-schema test tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .. import schema

#: The same text runs in Spark and DuckDB.
VIEWS = {
    "v_brands": """
select cast(n_nationkey as bigint) as id, n_name as name, lower(n_name) as slug, (n_nationkey % 5) <> 1 as active from nation""",
    "v_products": """
select p_partkey as id, p_partkey % 25 as brand_id, concat(p_brand,' ',p_type,' ',p_name) as name,
       lower(concat(p_brand,' ',p_type,' ',p_name)) as normalized_name, p_type as category,
       case when p_partkey % 17 = 0 then null else lower(p_brand) end as manufacturer_brand,
       case when p_partkey % 19 = 0 then null else lower(p_type) end as category_normalised,
       cast(p_size % 5 + 1 as decimal(10,3)) as size_value, 'ml' as size_unit, 1 as pack_count, p_name as variant_descriptor,
       case when p_partkey % 3 = 0 then null else p_partkey % 97 + 1 end as canonical_product_id,
       case when p_partkey % 7 = 0 then '' else concat('/img/', cast(p_partkey as varchar(20)), '.png') end as image_url,
       case when p_partkey % 5 = 0 then null else cast(p_partkey as varchar(20)) end as external_id
from part""",
    "v_offers": """
select (((l_orderkey*10+l_linenumber)*100000+l_partkey)*10000+l_suppkey)*100 + cast(l_quantity as bigint) as id,
       l_partkey as product_id, cast(l_suppkey as bigint) as crawl_run_id,
       cast(round(cast(l_extendedprice as decimal(12,2)) * (1-cast(l_discount as decimal(3,2))),2) as decimal(12,2)) as price,
       case when l_discount>0 then cast(l_extendedprice as decimal(12,2)) end as original_price,
       case when l_discount>0 then cast(round(l_discount*100) as int) end as discount_pct,
       case when l_linenumber=7 then null else cast(l_shipdate as date) end as valid_from,
       case when l_linenumber=7 then null else cast(l_shipdate + interval 60 day as date) end as valid_to,
       l_shipdate as scraped_at,
       case when l_linenumber % 3 = 0 then ' ' when l_linenumber % 4 = 0 then l_returnflag end as promo_label
from lineitem""",
    "v_runs": """
select o_orderkey as id, o_custkey % 25 as brand_id, o_orderdate as finished_at,
       case o_orderstatus when 'F' then 'success' when 'O' then 'running' else 'failed' end as status from orders""",
}
BASE = ("nation", "part", "lineitem", "orders")


@dataclass(frozen=True)
class Retail:
    brands: DataFrame
    products: DataFrame
    offers: DataFrame
    runs: DataFrame


def star_views(spark: SparkSession, sf_dir: str) -> Retail:
    """The views above; plans prune their columns and push filters to the Parquet scans below."""
    at = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE}
    got = [spark.sql(text.replace(f"from {t}", f"from {{{t}}}"), **{t: at[t]}) for text, t in zip(VIEWS.values(), BASE, strict=True)]
    return Retail(*got)


def read_tables(spark: SparkSession, folder: str) -> Retail:
    """The engine's own tables, with their declared schemas."""
    kinds = {"brands": schema.BRANDS, "products": schema.PRODUCTS, "offers": schema.OFFERS, "crawl_runs": schema.CRAWL_RUNS}
    return Retail(*(spark.read.schema(s).parquet(f"{folder}/{t}") for t, s in kinds.items()))


def with_views(sql: str) -> str:
    """Oracle SQL with the views that it names in front."""
    used = [f"{name} as ({text})" for name, text in VIEWS.items() if name in sql]
    return f"with {', '.join(used)}{',' if sql.lstrip().startswith(',') else ''} {sql.lstrip().removeprefix(',')}" if used else sql
