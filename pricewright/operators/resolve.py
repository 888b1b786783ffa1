"""Equal products across chains: blocks, pair rules, vectors for doubtful pairs, components and payloads.

Features are rows (product_id, brand_slug, name, category, manufacturer, size struct, pack, variant_tokens,
canonical_key). A block is one maker, size and pack; blocks larger than the cap aren't compared, so the pairs of a
block never pass ``cap * (cap - 1) / 2`` whatever the data.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import cosine, jaccard


@dataclass(frozen=True)
class MatchConfig:
    auto_merge_cosine: float = 0.95
    review_cosine: float = 0.85
    rule_floor: float = 0.40
    rule_merge: float = 0.95
    max_block: int = 8


#: What the command line uses: vectors merge a little later.
CLI = MatchConfig(auto_merge_cosine=0.97)
BLOCK = ("manufacturer", "size", "pack")


def decision(a: str = "a", b: str = "b") -> Column:
    """struct(same, confidence, reason) of a pair, from columns ``a.*`` and ``b.*``."""
    x = lambda c: F.col(f"{a}.{c}")
    y = lambda c: F.col(f"{b}.{c}")
    j = jaccard(x("variant_tokens"), y("variant_tokens"))
    none = (F.size(x("variant_tokens")) == 0) & (F.size(y("variant_tokens")) == 0)
    apart = (F.size(x("variant_tokens")) > 0) & (F.size(y("variant_tokens")) > 0) & (j == 0)
    say = lambda same, conf, why: F.struct(F.lit(same).alias("same"), (conf if isinstance(conf, Column) else F.lit(float(conf))).alias("confidence"), F.lit(why).alias("reason"))
    return (
        F.when(x("manufacturer").isNull() | y("manufacturer").isNull(), say(False, 1, "maker unknown"))
        .when(x("manufacturer") != y("manufacturer"), say(False, 1, "maker"))
        .when(~x("size").eqNullSafe(y("size")), say(False, 1, "size"))
        .when(x("pack") != y("pack"), say(False, 1, "pack"))
        .when(none, say(True, 1, "no variant"))
        .when(apart, say(False, 1, "disjoint variants"))
        .when(j >= 0.5, say(True, F.lit(0.90) + F.lit(0.10) * j, "variants"))
        .when(j >= 0.25, say(False, 0.6, "some variants"))
        .otherwise(say(False, 0.95, "variants differ"))
    )


def route(decided: Column, cos: Column, config: MatchConfig = MatchConfig(), use_vectors: bool = True) -> Column:
    """Where a pair goes: merged or dropped by rule, merged, queued for review or dropped by its vectors."""
    sure = decided["confidence"] >= config.rule_merge
    unknown = F.lit(not use_vectors) | cos.isNull() | (decided["confidence"] < config.rule_floor)
    return (
        F.when(sure & decided["same"], "rule_merged")
        .when(sure | unknown, "rule_dropped")
        .when(cos >= config.auto_merge_cosine, "embedding_merged")
        .when(cos >= config.review_cosine, "review")
        .otherwise("embedding_dropped")
    )


def blocks(features: DataFrame) -> DataFrame:
    """Features with the size of their block; those without a maker have none. Sizes are counted first, so no task gathers a block."""
    rows = features.where("manufacturer is not null")
    sizes = rows.groupBy(*BLOCK).agg(F.count("*").alias("block_size"))
    sizes = sizes.select(*[F.col(c).alias(f"__{c}") for c in BLOCK], "block_size")
    return rows.join(sizes, _same_block("", "__")).drop(*[f"__{c}" for c in BLOCK])


def _same_block(a: str, b: str) -> Column:
    """Equal maker, size (which may be unknown) and pack."""
    return (F.col(f"{a}manufacturer") == F.col(f"{b}manufacturer")) & F.col(f"{a}size").eqNullSafe(F.col(f"{b}size")) & F.col(f"{a}pack").eqNullSafe(F.col(f"{b}pack"))


def block_pairs(features: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """(a, b) structs of every pair of a block within the cap, a before b by product id."""
    inside = blocks(features).where(F.col("block_size").between(2, config.max_block)).drop("block_size")
    a, b = inside.select(F.struct("*").alias("a")), inside.select(F.struct("*").alias("b"))
    return a.join(b, _same_block("a.", "b.") & (F.col("a.product_id") < F.col("b.product_id")))


def scored_pairs(features: DataFrame, vectors: DataFrame | None = None, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Pairs with decision, cosine and route. ``vectors`` (product_id, vector of length 1) serve only pairs the rules leave open."""
    pairs = block_pairs(features, config).withColumn("decision", decision())
    if vectors is None:
        return pairs.withColumn("cosine", F.lit(None).cast("double")).withColumn("route", route(F.col("decision"), F.col("cosine"), config, False))
    va, vb = (vectors.select(F.col("product_id").alias(f"{s}_id"), F.col("vector").alias(f"v{s}")) for s in "ab")
    pairs = pairs.join(va, F.col("a.product_id") == F.col("a_id"), "left").join(vb, F.col("b.product_id") == F.col("b_id"), "left")
    doubtful = (F.col("decision.confidence") < config.rule_merge) & (F.col("decision.confidence") >= config.rule_floor)
    cos = F.when(doubtful & F.col("va").isNotNull() & F.col("vb").isNotNull(), cosine(F.col("va"), F.col("vb")))
    return pairs.withColumn("cosine", cos).drop("va", "vb", "a_id", "b_id").withColumn("route", route(F.col("decision"), F.col("cosine"), config))


def component_of(node: Column, edges: Column, max_size: int = 8) -> Column:
    """The least id that ``node`` reaches over an array of edges (a, b), where no component has more than ``max_size`` nodes."""

    def onward(seen, _):
        ahead = F.transform(F.filter(edges, lambda e: F.array_contains(seen, e["a"])), lambda e: e["b"])
        back = F.transform(F.filter(edges, lambda e: F.array_contains(seen, e["b"])), lambda e: e["a"])
        return F.array_union(seen, F.concat(ahead, back))

    reached = F.aggregate(F.sequence(F.lit(1), F.lit(max(1, max_size - 1))), F.array(node), onward)
    return F.when(F.size(edges) > 0, F.array_min(reached)).otherwise(node)


def components(nodes: DataFrame, edges: DataFrame, block: str = "block", max_size: int = 8) -> DataFrame:
    """(id, component) of nodes (id, block) over edges (a, b, block). A block's edges are few, as its nodes are."""
    by = edges.groupBy(block).agg(F.collect_list(F.struct("a", "b")).alias("edges"))
    return nodes.join(by, block, "left").select("id", component_of(F.col("id"), F.col("edges"), max_size).alias("component"))


def groups(features: DataFrame, pairs: DataFrame, config: MatchConfig = MatchConfig()) -> DataFrame:
    """Features with their component, the way each product joined it, and the group's key.

    A product's way is that of its first accepted pair, ``rule`` if it has none. Two components with one key are told
    apart by ``key#root``; the one of the least root keeps the plain key. The accepted pairs of a block travel as one
    array, so components cost one join.
    """
    block = lambda at: F.to_json(F.struct(*[F.col(f"{at}{c}").alias(c) for c in BLOCK]))
    known = features.where("manufacturer is not null").withColumn("block", block(""))
    merged = pairs.where(F.col("route").isin("rule_merged", "embedding_merged"))
    edge = F.struct(F.col("a.product_id").alias("a"), F.col("b.product_id").alias("b"), F.split("route", "_")[0].alias("way"))
    merged = merged.groupBy(block("a.").alias("block")).agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    mine = F.filter("edges", lambda e: (e["a"] == F.col("product_id")) | (e["b"] == F.col("product_id")))
    rows = known.join(merged, "block", "left")
    rows = rows.withColumns({"component": component_of(F.col("product_id"), F.col("edges"), config.max_block), "method": F.coalesce(F.try_element_at(mine, F.lit(1))["way"], F.lit("rule"))}).drop("edges", "block")
    rows = rows.withColumn("least", F.min("canonical_key").over(Window.partitionBy("component")))
    nth = F.dense_rank().over(Window.partitionBy("least").orderBy("component"))
    return rows.withColumn("group_key", F.when(nth == 1, F.col("least")).otherwise(F.concat("least", F.lit("#"), F.col("component").cast("string")))).drop("least")


def exact_groups(features: DataFrame) -> DataFrame:
    """Phase one: products of equal keys."""
    return features.where("canonical_key is not null").withColumn("group_key", F.col("canonical_key")).withColumn("component", F.min("product_id").over(Window.partitionBy("canonical_key"))).withColumn("method", F.lit("rule"))


def title(tokens: Column) -> Column:
    """Words in title case; a letter after a digit or mark is a capital too."""
    up = lambda w: F.array_join(F.transform(F.split(w, "(?<![a-zα-ω])(?=[a-zα-ω])"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1000))), "")
    return F.array_join(F.transform(tokens, up), " ")


def payloads(grouped: DataFrame, include_singletons: bool = True) -> DataFrame:
    """One row a group: facts of its anchor (the lowest product id), name and category of its longest name, and members.

    A member that joined by vectors has confidence 0.9; others 1 if the rules call them the same as the anchor, else 0.85.
    """
    anchor = grouped.groupBy("component").agg(F.min_by(F.struct("manufacturer", "size", "pack", "variant_tokens"), "product_id").alias("a"))
    rows = grouped.join(anchor, "component").withColumn("b", F.struct("manufacturer", "size", "pack", "variant_tokens"))
    sure = F.when(F.col("method") == "embedding", 0.9).when(decision()["same"], 1.0).otherwise(0.85)
    rows = rows.withColumn("member", F.struct("product_id", sure.cast("decimal(4,3)").alias("confidence"), F.col("method").alias("match_method")))
    longest = F.struct(F.length("name"), -F.col("product_id"))
    out = rows.groupBy("group_key").agg(
        F.first("a").alias("a"),
        F.max_by("name", longest).alias("display_name"),
        F.max_by("category", longest).alias("category"),
        F.array_sort(F.collect_list("member")).alias("members"),
        F.count_distinct("brand_slug").alias("brands_count"),
    )
    if not include_singletons:
        out = out.where(F.size("members") >= 2)
    tokens = F.slice(F.array_sort("a.variant_tokens"), 1, 4)
    return out.select(
        F.col("group_key").alias("canonical_key"),
        F.col("a.manufacturer").alias("manufacturer_brand"),
        F.col("a.size.value").alias("size_value"),
        F.col("a.size.unit").alias("size_unit"),
        F.col("a.pack").alias("pack_count"),
        F.nullif(title(tokens), F.lit("")).alias("variant_descriptor"),
        "display_name",
        "category",
        "members",
        "brands_count",
    )


def confident(payload: DataFrame, least: float = 0.85) -> DataFrame:
    return payload.where(F.exists("members", lambda m: m["confidence"] >= least))


def group_summary(payload: DataFrame) -> DataFrame:
    n = F.size("members")
    return payload.agg(
        F.count("*").alias("groups"), F.count_if(n == 1).alias("singletons"), F.count_if(n >= 2).alias("multi"),
        F.count_if(F.col("brands_count") >= 2).alias("two_brands"), F.count_if(F.col("brands_count") >= 3).alias("three_brands"),
    )


def pair_statistics(pairs: DataFrame) -> DataFrame:
    """How many pairs went each way; merges count accepted pairs."""
    names = ("rule_merged", "rule_dropped", "embedding_merged", "review", "embedding_dropped")
    return pairs.agg(F.count("*").alias("pairs_evaluated"), *[F.count_if(F.col("route") == n).alias(f"pairs_{n}") for n in names])


def joining_pairs(pairs: DataFrame) -> DataFrame:
    """How many accepted pairs joined two components that were apart, by way; pairs of a block in order of their ids.

    A block's pairs are one array of at most 28; labels are carried along it, so nothing leaves the aggregate.
    """
    merged = pairs.where(F.col("route").isin("rule_merged", "embedding_merged"))
    edge = F.struct(F.col("a.product_id").alias("a"), F.col("b.product_id").alias("b"), (F.col("route") == "rule_merged").alias("rule"))
    by = merged.groupBy(F.to_json(F.struct(*[F.col(f"a.{c}") for c in BLOCK])).alias("block")).agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    nodes = F.array_distinct(F.concat(F.transform("edges", lambda e: e["a"]), F.transform("edges", lambda e: e["b"])))
    start = F.struct(F.transform(nodes, lambda n: F.struct(n.alias("id"), n.alias("of"))).alias("labels"), F.lit(0).alias("rule"), F.lit(0).alias("vector"))

    def step(acc, e):
        of = lambda n: F.filter(acc["labels"], lambda x: x["id"] == n)[0]["of"]
        apart = of(e["a"]) != of(e["b"])
        labels = F.transform(acc["labels"], lambda x: F.struct(x["id"].alias("id"), F.when(x["of"] == of(e["b"]), of(e["a"])).otherwise(x["of"]).alias("of")))
        return F.struct(labels.alias("labels"), (acc["rule"] + (apart & e["rule"]).cast("int")).alias("rule"), (acc["vector"] + (apart & ~e["rule"]).cast("int")).alias("vector"))

    done = by.select(F.aggregate("edges", start, step).alias("d"))
    return done.agg(F.coalesce(F.sum("d.rule"), F.lit(0)).alias("joined_by_rule"), F.coalesce(F.sum("d.vector"), F.lit(0)).alias("joined_by_vector"))


def collect_features(offers: DataFrame, order: str = "position") -> DataFrame:
    """Products of a listing, each once, the first; rows without an id or a name are left out."""
    by = Window.partitionBy("product_id").orderBy(order)
    rows = offers.where("product_id is not null and coalesce(trim(name), '') <> ''").withColumn("__n", F.row_number().over(by))
    return rows.where("__n = 1").drop("__n")


def vector_text(name: Column) -> Column:
    """What a sentence model is given."""
    return F.concat(F.lit("query: "), name)


def review_queue(pairs: DataFrame) -> DataFrame:
    """Pairs for a person to look at, by their ids."""
    rows = pairs.where("route = 'review'")
    return rows.select(F.col("a.product_id").alias("a_id"), F.col("b.product_id").alias("b_id"), F.round("cosine", 4).alias("cosine"), F.round("decision.confidence", 4).alias("rule_confidence")).orderBy("a_id", "b_id")


def coverage(features: DataFrame) -> DataFrame:
    some = lambda c: F.count_if(F.col(c).isNotNull())
    return features.agg(F.count("*").alias("products"), some("manufacturer").alias("with_manufacturer"), some("size").alias("with_size"), F.count_if(F.col("pack") >= 2).alias("multi_packs"), some("canonical_key").alias("with_key"))


def canonicalise(products: DataFrame, vectors: DataFrame | None = None, config: MatchConfig = CLI, brands=None, include_singletons: bool = False, batch: int = 200) -> dict[str, DataFrame]:
    """Products (product_id, brand_slug, name, category) matched across chains, from names to what is pushed.

    Returns ``features`` of all products, ``pairs`` that were compared, ``payload`` (groups with the number of their batch,
    only those with a member sure enough), ``review`` (pairs for a person), and one-row counters ``statistics``,
    ``joined``, ``summary`` and ``coverage``. Products without a name or a known maker are counted but not matched.
    """
    from ..functions import text
    from ..sources import sinks

    features = text.with_features(products, brands=brands or text.BRANDS)
    pairs = scored_pairs(features, vectors, config)
    payload = confident(payloads(groups(features, pairs, config), include_singletons))
    return {
        "features": features, "pairs": pairs, "payload": sinks.batches(payload, batch), "review": review_queue(pairs),
        "statistics": pair_statistics(pairs), "joined": joining_pairs(pairs), "summary": group_summary(payload), "coverage": coverage(features),
    }


def key_clusters(products: DataFrame, key: str, chain: str, least: int = 2, rows: int = 40) -> DataFrame:
    """The match keys that most chains share."""
    by = products.groupBy(key).agg(F.count("*").alias("products"), F.count_distinct(chain).alias("chains"))
    return by.where(F.col("chains") >= least).orderBy(F.desc("chains"), F.desc("products"), key).limit(rows)
