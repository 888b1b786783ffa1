"""Writes as table-to-table transforms: validation, product upsert, offers, canonical upsert, run lifecycle.

Each takes the present table and what comes in, and returns the new table and counters or rejects; the caller writes
the result beside the old one and swaps. Order among incoming rows is an explicit column, never the order of arrival.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..schema import MATCH_METHODS, PROMO_TYPES, TERMINAL_STATUSES
from .core import cut, numbered, promo_signal

FEATURES = ("manufacturer_brand", "category_normalised", "size_value", "size_unit", "pack_count", "variant_descriptor")
REFRESHED = ("name", "normalized_name", "url", "image_url", "category", "unit")


def offer_errors() -> Column:
    """What is wrong with an incoming offer, as a list; empty if nothing is."""
    long = lambda c, n: F.length(c) > n
    checks = {
        "name is required": F.coalesce(F.length(F.trim("name")), F.lit(0)) == 0,
        "name is too long": long("name", 500),
        "price is required": F.col("price").isNull(),
        "price is negative": F.col("price") < 0,
        "original_price is negative": F.col("original_price") < 0,
        "discount_pct is 0 to 100": ~F.col("discount_pct").between(0, 100),
        "promo_label is too long": long("promo_label", 80),
        "promo_type is unknown": ~F.col("promo_type").isin(*PROMO_TYPES),
        "currency has three letters": F.length("currency") != 3,
        "scraped_at is required": F.col("scraped_at").isNull(),
        "valid_to is before valid_from": F.col("valid_to") < F.col("valid_from"),
        "no sign of a promotion": ~promo_signal(),
    }
    found = F.array(*[F.when(bad, F.lit(text)) for text, bad in checks.items()])
    return F.filter(found, lambda x: x.isNotNull())


def split_offers(incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``errors``)."""
    checked = incoming.withColumn("errors", offer_errors())
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def resolve_products(products: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows (brand_id, external_id, name, normalized_name, ..., seq) with the id of the product they are, and whether they made it.

    As if the rows came one after the other in order of ``seq``, which no two of them share: a row is the product of its
    chain and external id, be it there before or made by an earlier row; else, of the chain's products without an
    external id, that of its normalised name; else it makes one. An empty external id is none. Ids go on from the
    highest, in order of the rows that make a product.

    Nothing runs row by row. A name's product is there from the first row without an external id that bears it, and an
    external id's from the first row that bears it while there is none of its name yet; both are minima over a key.
    """
    ext = F.nullif(F.col("external_id"), F.lit(""))
    rows, old = incoming.withColumn("external_id", ext), products.withColumn("external_id", ext)
    by_ext = old.where("external_id is not null").groupBy("brand_id", "external_id").agg(F.min("id").alias("ext_id"))
    by_name = old.where("external_id is null").groupBy("brand_id", "normalized_name").agg(F.min("id").alias("name_id"))
    named = rows.where("external_id is null").groupBy("brand_id", "normalized_name").agg(F.min("seq").alias("name_seq"))
    rows = rows.join(by_ext, ["brand_id", "external_id"], "left")
    rows = rows.join(by_name.join(named, ["brand_id", "normalized_name"], "full"), ["brand_id", "normalized_name"], "left")
    has_name = F.col("name_id").isNotNull() | F.coalesce(F.col("name_seq") < F.col("seq"), F.lit(False))
    made = rows.where("external_id is not null and ext_id is null").where(~has_name).groupBy("brand_id", "external_id").agg(F.min("seq").alias("ext_seq"))
    rows = rows.join(made, ["brand_id", "external_id"], "left")
    by_own = F.coalesce(F.col("ext_seq") <= F.col("seq"), F.lit(False))
    rows = rows.withColumn("found", F.when(F.col("ext_id").isNotNull(), F.col("ext_id")).when(~by_own, F.col("name_id")))
    rows = rows.withColumn("made_at", F.when(F.col("found").isNull(), F.when(by_own, F.col("ext_seq")).otherwise(F.col("name_seq"))))
    rows = rows.withColumn("created", F.col("made_at").isNotNull() & (F.col("made_at") == F.col("seq"))).drop("ext_id", "name_id", "name_seq", "ext_seq")
    top = products.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row
    fresh = numbered(rows.where("created").select(F.col("seq").alias("made_at")), "made_at", "nth").crossJoin(F.broadcast(top)).select("made_at", (F.col("top") + F.col("nth")).alias("new_id"))
    return rows.join(fresh, "made_at", "left").withColumn("product_id", F.coalesce("found", "new_id")).drop("found", "new_id", "made_at")


def merge_products(products: DataFrame, resolved: DataFrame) -> DataFrame:
    """The products after an ingest: the last row of each product refreshes names, links and features.

    The external id is that of the row that made the product; it is never filled in later.
    """
    have = [c for c in (*REFRESHED, *FEATURES) if c in resolved.columns and c in products.columns]
    last = resolved.groupBy("product_id").agg(F.max_by(F.struct(*have), "seq").alias("n"), F.first("brand_id").alias("n_brand"), F.max(F.when(F.col("created"), F.col("external_id"))).alias("n_ext"))
    rows = products.join(last, products["id"] == last["product_id"], "full")
    known = F.col("product_id").isNotNull()
    values = {"id": F.coalesce("id", "product_id"), "brand_id": F.coalesce("brand_id", "n_brand"), "external_id": F.when(F.col("id").isNull(), F.col("n_ext")).otherwise(F.col("external_id"))}
    values |= {c: F.when(known, F.col(f"n.{c}")).otherwise(F.col(c)) for c in have}
    return rows.select(*[values.get(c, F.col(c)).alias(c) for c in products.columns])


def new_offers(offers: DataFrame, resolved: DataFrame, run_id: int) -> DataFrame:
    """One offer a resolved row, to be appended; ids go on from the highest, in order of the rows."""
    top = offers.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = numbered(resolved, "seq", "nth").crossJoin(F.broadcast(top))
    values = {"id": F.col("top") + F.col("nth"), "crawl_run_id": F.lit(run_id).cast("long"), "currency": F.coalesce("currency", F.lit("EUR")) if "currency" in resolved.columns else F.lit("EUR")}
    return rows.select(*[values.get(c, F.col(c) if c in resolved.columns else F.lit(None)).cast(offers.schema[c].dataType).alias(c) for c in offers.columns])


def ingest_counts(resolved: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """Offers kept, rows that made a product, and rows that changed one.

    With ``products`` (before the ingest) a row counts as an update if it differs in a refreshed column from the row of
    its product before it, or from the product as it was; without, every row of a product that it didn't make does.
    """
    changed = ~F.col("created")
    if products is not None:
        have = [c for c in (*REFRESHED, *FEATURES) if c in resolved.columns and c in products.columns]
        was = products.select(F.col("id").alias("product_id"), F.struct(*have).alias("__was"))
        before = F.lag(F.struct(*have)).over(Window.partitionBy("product_id").orderBy("seq"))
        resolved = resolved.join(was, "product_id", "left").withColumn("__before", F.coalesce(before, F.col("__was")))
        same = [F.col(c).cast(products.schema[c].dataType).eqNullSafe(F.col(f"__before.{c}").cast(products.schema[c].dataType)) for c in have]
        changed = changed & ~F.forall(F.array(*same), lambda x: x) if same else F.lit(False)
    return resolved.agg(F.count("*").alias("offers_persisted"), F.count_if("created").alias("products_created"), F.count_if(changed).alias("products_updated"))


def ingest(products: DataFrame, offers: DataFrame, incoming: DataFrame, run: tuple[int, int, str], brands=None) -> dict[str, DataFrame]:
    """One crawl run's items taken in whole: validated, resolved, merged, appended, counted.

    ``run``: id, brand id and status of the run; only a running one takes offers. ``incoming`` has the columns of an
    offer item and ``seq``. Returns the new ``products``, the ``offers`` to append, the ``rejected`` items with their
    errors, and ``counts`` (one row). Items of no run, an empty table and repeated items need nothing special: a repeated
    item is one more offer of the same product.
    """
    run_id, brand_id, status = run
    if status != "running":
        raise ValueError(f"run {run_id} has ended")
    accepted, rejected = split_offers(incoming)
    rows = accepted.withColumns({"brand_id": F.lit(brand_id).cast("long"), "normalized_name": text.normalize(F.col("name"))})
    for c, value in catalogue_features(brands).items():
        rows = rows.withColumn(c, value)
    rows = rows.drop("__maker", "__size")
    resolved = resolve_products(products, rows)
    return {"products": merge_products(products, resolved), "offers": new_offers(offers, resolved, run_id), "rejected": rejected, "counts": ingest_counts(resolved, products)}


def catalogue_features(brands=None) -> dict[str, Column]:
    """The six family features of ``name`` and ``category`` by the catalogue profile, maker and category without accents, and two helpers; to be added one after the other."""
    names = brands or text.BRANDS
    tokens = text.variant_tokens(F.col("name"), F.col("__maker"), names, "catalogue")
    return {
        "__maker": text.manufacturer(F.col("name"), names), "__size": text.size(F.col("name"), "catalogue"),
        "manufacturer_brand": F.col("__maker"), "category_normalised": F.nullif(text.normalize(F.col("category")), F.lit("")), "size_value": F.col("__size.value").cast("decimal(10,3)"),
        "size_unit": F.col("__size.unit"), "pack_count": text.pack_count(F.col("name"), "catalogue"), "variant_descriptor": text.variant_slug(tokens, "catalogue"),
    }


def backfill(products: DataFrame, brands=None) -> DataFrame:
    """All products with their six family features worked out anew."""
    new = catalogue_features(brands)
    rows = products.drop(*FEATURES)
    for c, value in new.items():
        rows = rows.withColumn(c, value)
    return rows.select(*[c for c in products.columns if c not in new], *[c for c in new if not c.startswith("__")])


def without_leaks(offers: DataFrame) -> DataFrame:
    """Offers that show a promotion; the rest are catalogue rows that leaked in."""
    return offers.where(promo_signal())


def grouping_errors() -> Column:
    bad = {
        "canonical_key is required": F.coalesce(F.length("canonical_key"), F.lit(0)) == 0,
        "members are 1 to 200": ~F.size("members").between(1, 200),
        "confidence is 0 to 1": F.exists("members", lambda m: ~m["confidence"].between(0, 1)),
        "match_method is unknown": F.exists("members", lambda m: ~m["match_method"].isin(*MATCH_METHODS)),
    }
    return F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in bad.items()]), lambda x: x.isNotNull())


def upsert_canonicals(canonicals: DataFrame, incoming: DataFrame) -> DataFrame:
    """Canonicals after an upsert by key; an image is only replaced by one that is there. ``outcome``: created, updated, same or kept."""
    facts = ("manufacturer_brand", "size_value", "size_unit", "pack_count", "variant_descriptor", "display_name", "category")
    rows = canonicals.withColumnsRenamed({c: f"o_{c}" for c in canonicals.columns if c != "canonical_key"}).join(
        incoming.withColumnsRenamed({c: f"n_{c}" for c in incoming.columns if c != "canonical_key"}), "canonical_key", "full"
    )
    have = [c for c in facts if c in incoming.columns and c in canonicals.columns]
    came = F.col("n_seq").isNotNull()
    image = F.coalesce("n_image_url", "o_image_url") if "image_url" in incoming.columns else F.col("o_image_url")
    dirty = F.lit(False)
    for c in have:
        dirty = dirty | ~F.col(f"n_{c}").eqNullSafe(F.col(f"o_{c}").cast(incoming.schema[c].dataType))
    dirty = dirty | ~image.eqNullSafe(F.col("o_image_url"))
    outcome = F.when(F.col("o_id").isNull(), "created").when(came & dirty, "updated").when(came, "same").otherwise("kept")
    top = canonicals.agg(F.coalesce(F.max("id"), F.lit(0)).alias("__top"))
    rows = rows.withColumn("outcome", outcome)
    added = numbered(rows.where("o_id is null").select("canonical_key", "n_seq"), "n_seq", "__nth").select("canonical_key", "__nth")
    rows = rows.join(added, "canonical_key", "left").crossJoin(F.broadcast(top))
    values = {"id": F.coalesce("o_id", F.col("__top") + F.col("__nth")), "canonical_key": F.col("canonical_key"), "image_url": image}
    values |= {c: F.when(came, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")) for c in have}
    return rows.select(*[values.get(c, F.col(f"o_{c}")).cast(canonicals.schema[c].dataType).alias(c) for c in canonicals.columns], "outcome")


def arbitrate(products: DataFrame, proposals: DataFrame) -> DataFrame:
    """Proposals (product_id, canonical_id, confidence, method, seq) with ``outcome``: assigned, kept_higher, duplicate_brand_skipped or unknown_product.

    As if they came one after the other in order of ``seq``: a product keeps its canonical only if the confidence it
    has by then is higher than the proposal's (equal wins), and of a chain one product at a time is in a canonical. An
    assignment that a later one replaces was still made; the last assigned proposal of a product holds.

    What a proposal meets depends only on earlier ones. So all are taken to be assigned at first, and each round judges
    every proposal by the outcomes of the round before, along two windows: its product's earlier proposals, and what
    came into and left its canonical of its chain. Rounds end when none changes an outcome, and then all are right; they
    are as many as proposals depend on each other in a chain, and no more than there are proposals.
    """
    now = products.select(F.col("id").alias("product_id"), "brand_id", F.col("canonical_product_id").alias("old_id"), F.col("canonical_match_confidence").cast("double").alias("old_confidence"))
    known = proposals.join(now, "product_id", "left")
    unknown = known.where("brand_id is null").withColumn("outcome", F.lit("unknown_product"))
    rows = cut(known.where("brand_id is not null").withColumn("outcome", F.lit("assigned")))
    held = now.where("old_id is not null").select(F.col("old_id").alias("slot"), "brand_id", F.lit(None).cast("long").alias("seq"), F.lit(0).alias("kind"), F.lit(1).alias("change"), F.lit(None).alias("row"))
    by_product = Window.partitionBy("product_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    by_slot = Window.partitionBy("slot", "brand_id").orderBy(F.asc_nulls_first("seq"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    columns = known.columns
    while True:
        taken = F.col("outcome") == "assigned"
        state = F.last(F.when(taken, F.struct(F.col("canonical_id").alias("id"), F.col("confidence").cast("double").alias("confidence"))), ignorenulls=True).over(by_product)
        judged = rows.withColumn("__now", F.coalesce(state, F.struct(F.col("old_id").alias("id"), F.col("old_confidence").alias("confidence"))))
        moves = taken & ~F.coalesce(F.col("__now.id") == F.col("canonical_id"), F.lit(False))
        row = F.struct(*columns, "outcome", "__now")
        # A move leaves one slot and comes into another; every proposal asks how many others are in its slot.
        event = lambda slot, kind, change, row: F.struct(slot.alias("slot"), F.lit(kind).alias("kind"), change.cast("int").alias("change"), row.alias("row"))
        leaves = F.when(moves & F.col("__now.id").isNotNull(), event(F.col("__now.id"), 1, F.lit(-1), F.lit(None).cast(judged.select(row.alias("r")).schema["r"].dataType)))
        comes = event(F.col("canonical_id"), 1, F.when(moves, 1).otherwise(0), row)
        events = judged.select("brand_id", "seq", F.explode(F.filter(F.array(leaves, comes), lambda e: e.isNotNull())).alias("e")).select("e.slot", "brand_id", "seq", "e.kind", "e.change", "e.row")
        events = events.unionByName(held.withColumn("row", F.lit(None).cast(events.schema["row"].dataType)))
        there = F.coalesce(F.sum("change").over(by_slot), F.lit(0))
        found = events.withColumn("there", there).where("row is not null").select("row.*", "there")
        others = F.col("there") - F.when(F.col("__now.id") == F.col("canonical_id"), 1).otherwise(0)
        higher = F.col("__now.id").isNotNull() & F.coalesce(F.col("__now.confidence") > F.col("confidence").cast("double"), F.lit(False))
        verdict = F.when(higher, "kept_higher").when(others > 0, "duplicate_brand_skipped").otherwise("assigned")
        step = cut(found.select(*columns, F.col("outcome").alias("__old"), verdict.alias("outcome")))
        done = not step.where("(outcome = 'assigned') <> (__old = 'assigned')").limit(1).count()
        rows = step.drop("__old")
        if done:
            return rows.unionByName(unknown)


def assign(products: DataFrame, arbitrated: DataFrame, at) -> DataFrame:
    """Products with the last assigned canonical of each written in."""
    last = arbitrated.where("outcome = 'assigned'").groupBy("product_id").agg(F.max_by(F.struct("canonical_id", "confidence", "method"), "seq").alias("w"))
    won = last.select(F.col("product_id").alias("id"), F.col("w.canonical_id").alias("to_id"), F.col("w.confidence").alias("to_conf"), F.col("w.method").alias("to_method"))
    rows = products.join(won, "id", "left")
    moved = F.col("to_id").isNotNull()
    new = {"canonical_product_id": F.col("to_id"), "canonical_match_confidence": F.col("to_conf").cast("decimal(4,3)"), "canonical_match_method": F.col("to_method"), "canonical_matched_at": F.lit(at).cast("timestamp")}
    return rows.select(*[F.when(moved, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in products.columns])


def refresh_canonicals(canonicals: DataFrame, membership: DataFrame) -> DataFrame:
    """Counts from the members, 0 without any; a name or image is filled in only where there is none."""
    m = membership.select(F.col("canonical_product_id").alias("id"), F.col("members_count").alias("m"), F.col("brands_count").alias("b"), F.col("display_name").alias("n"), F.col("image_url").alias("i"))
    rows = canonicals.join(m, "id", "left")
    new = {"members_count": F.coalesce("m", F.lit(0)), "brands_count": F.coalesce("b", F.lit(0)), "display_name": F.coalesce(F.nullif("display_name", F.lit("")), "n"), "image_url": F.coalesce(F.nullif("image_url", F.lit("")), "i")}
    return rows.select(*[new[c].cast(canonicals.schema[c].dataType).alias(c) if c in new else F.col(c) for c in canonicals.columns])


def bulk_upsert(canonicals: DataFrame, products: DataFrame, groupings: DataFrame, at) -> dict[str, DataFrame]:
    """A batch of groupings (canonical_key, facts, members, seq) taken in whole: canonicals made or updated, members assigned, counts refreshed.

    Returns the new ``canonicals`` and ``products``, the ``rejected`` groupings with their errors, what came of each member
    (``outcomes``), and ``counts`` (one row). A key that comes twice is one canonical with the last facts and the last
    image that is there; its members are proposals of both. Members keep the order of groupings, then of their list.
    """
    from ..plans.canonical import membership

    checked = cut(groupings.withColumn("errors", grouping_errors()))
    good = checked.where(F.size("errors") == 0).drop("errors")
    facts = [c for c in good.columns if c not in ("canonical_key", "members", "image_url")]
    image = [F.max_by("image_url", F.when(F.col("image_url").isNotNull(), F.col("seq"))).alias("image_url")] if "image_url" in good.columns else []
    once = good.groupBy("canonical_key").agg(F.max_by(F.struct(*facts), "seq").alias("f"), F.min("seq").alias("first"), *image)
    once = once.select("canonical_key", *[F.col("first").alias("seq") if c == "seq" else F.col(f"f.{c}").alias(c) for c in facts], *(["image_url"] if image else []))
    upserted = cut(upsert_canonicals(canonicals, once))
    ids = upserted.select("canonical_key", F.col("id").alias("canonical_id"))
    members = good.select("canonical_key", "seq", F.posexplode("members").alias("nth", "m")).join(ids, "canonical_key")
    proposals = members.select("m.product_id", "canonical_id", "m.confidence", F.col("m.match_method").alias("method"), (F.col("seq") * 1000 + F.col("nth")).alias("seq"))
    outcomes = arbitrate(products, cut(proposals))
    assigned = assign(products, outcomes, at)
    count = lambda name: F.count_if(F.col("outcome") == name)
    upserts = upserted.agg(count("created").alias("created"), count("updated").alias("updated"))
    results = outcomes.agg(count("assigned").alias("products_assigned"), count("duplicate_brand_skipped").alias("duplicate_brand_skipped"), count("unknown_product").alias("errors"))
    return {
        "canonicals": refresh_canonicals(upserted.drop("outcome"), membership(assigned)), "products": assigned, "rejected": checked.where(F.size("errors") > 0),
        "outcomes": outcomes, "counts": upserts.join(results),
    }


def start_run_errors(brands: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (slug, ...) with what keeps the run from starting; null if nothing does."""
    rows = requests.join(brands.select("slug", "active"), "slug", "left")
    return rows.withColumn("error", F.when(F.col("active").isNull(), "unknown brand").when(~F.col("active"), "brand is not active")).drop("active")


def finish_runs(runs: DataFrame, updates: DataFrame, offers: DataFrame | None = None) -> DataFrame:
    """Runs after updates (id, status, finished_at, offers_found, offers_persisted, error_message), with ``error`` where one was refused.

    Only a running run can end, in a terminal status, with no more offers kept than found; kept offers that aren't
    stated are counted.
    """
    u = updates.withColumnsRenamed({c: f"u_{c}" for c in updates.columns if c != "id"})
    rows = runs.join(u, "id", "left")
    if offers is not None:
        counted = offers.groupBy(F.col("crawl_run_id").alias("id")).agg(F.count("*").cast("int").alias("__n"))
        rows = rows.join(counted, "id", "left").withColumn("u_offers_persisted", F.coalesce("u_offers_persisted", "__n", F.lit(0))).drop("__n")
    came = F.col("u_status").isNotNull()
    error = F.when(came & (F.col("status") != "running"), "run has ended").when(came & ~F.col("u_status").isin(*TERMINAL_STATUSES), "status isn't final").when(came & (F.col("u_offers_persisted") > F.col("u_offers_found")), "more offers kept than found")
    rows = rows.withColumn("error", error)
    ok = came & F.col("error").isNull()
    changed = [c for c in ("status", "finished_at", "offers_found", "offers_persisted", "error_message") if f"u_{c}" in rows.columns]
    return rows.select(*[F.when(ok, F.coalesce(f"u_{c}", c)).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in runs.columns], "error")


def orphans(child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
    """Rows whose parent isn't there."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col("id").alias(key)), key, "left_anti")


def pushable(run_status: Column) -> Column:
    return run_status == "running"
