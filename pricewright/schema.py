"""Tables of the engine and the values their columns may take."""

from __future__ import annotations

#: Fixed values.
RUN_STATUSES = ("running", "success", "failed", "partial")
TERMINAL_STATUSES = ("success", "failed", "partial")
TRIGGERS = ("schedule", "manual", "api")
PROMO_TYPES = ("strikethrough", "bxgy_free", "bxg_percent", "discount_euros", "loyalty_points")
MATCH_METHODS = ("exact_key", "rule", "embedding", "manual")
FAMILY = ("manufacturer_brand", "category_normalised", "size_value", "size_unit", "pack_count")


#: Column lists, as ``DataFrameReader.schema`` takes them.
BRANDS = ("id long, name string, slug string, website_url string, country_code string, active boolean")
CRAWL_CONFIGS = ("id long, brand_id long, strategy string, start_url string, rate_limit_ms int, respect_robots_txt boolean, cache_ttl_seconds int, schedule_cron string")
CRAWL_RUNS = ("id long, brand_id long, started_at timestamp, finished_at timestamp, status string, offers_found int, offers_persisted int, error_message string, triggered_by string")
PRODUCTS = (
    "id long, brand_id long, external_id string, name string, normalized_name string, url string, image_url string, category string, unit string, canonical_product_id long, "
    "manufacturer_brand string, category_normalised string, size_value decimal(10,3), size_unit string, pack_count int, variant_descriptor string, "
    "canonical_match_confidence decimal(4,3), canonical_match_method string, canonical_matched_at timestamp"
)
OFFERS = (
    "id long, product_id long, crawl_run_id long, price decimal(10,2), original_price decimal(10,2), discount_pct int, currency string, valid_from date, valid_to date, "
    "scraped_at timestamp, promo_label string, promo_type string"
)
CANONICAL_PRODUCTS = (
    "id long, canonical_key string, manufacturer_brand string, size_value decimal(10,3), size_unit string, pack_count int, variant_descriptor string, display_name string, "
    "category string, image_url string, members_count int, brands_count int"
)
#: What a source yields for one offer, before it is resolved to a product.
OFFER_ITEM = (
    "external_id string, name string, url string, image_url string, category string, unit string, price decimal(10,2), original_price decimal(10,2), discount_pct int, "
    "promo_label string, promo_type string, currency string, valid_from date, valid_to date, scraped_at timestamp"
)
