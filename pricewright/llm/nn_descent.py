"""Embedding near duplicates by NN-descent.

Equal vectors are one node with a weight. Random hyperplanes give every node a first list of near neighbours; rounds of
neighbours-of-neighbours joins refine the lists; lists that hold only links are enlarged. Edges at the threshold join
nodes into components. Lists are short and the search may miss pairs, so every node is then compared with every other in
blocks: that counts each link, and joins components which the search left apart.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, table
from .graph import components

THRESHOLD = 0.95
#: Neighbours on a list, and on one that was enlarged as often as is of use; component blocks count beyond it.
LIST, LONGEST = 12, 48
#: Neighbours of a lower cosine aren't listed: two links of one node have at least 2 * 0.95**2 - 1 = 0.805.
FLOOR = 0.6
#: Hyperplane tables of a start, rows of a bucket compared at once, and rounds of refinement at most.
TABLES, CHUNK, ROUNDS = 6, 128, 6
#: Nodes of a block, blocks and bytes of vectors that are broadcast at once to be compared with all, and cosines that are held at once.
BLOCK, BLOCKS, CHUNK_BYTES, TILE = 1024, 16, 1 << 23, 1 << 22


def unit_vector(x) -> bytes | None:
    """The vector over its length, as doubles; None if it is null, empty, zero or holds null or non-finite parts."""
    if not x or any(v is None for v in x):
        return None
    v = np.array(x, np.float64)
    top = np.abs(v).max()
    if not np.isfinite(v).all() or top == 0:
        return None
    v = v / top
    return (v / np.sqrt((v * v).sum())).tobytes()


def unit_table(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, h (digest of the unit vector; null if it links with nothing) and unit of each row."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                units = [unit_vector(x) for x in part.column(vector).to_pylist()]
                h = [None if u is None else hashlib.blake2b(u, digest_size=16).hexdigest() for u in units]
                yield pa.RecordBatch.from_arrays([part.column("vec_id").cast(pa.int64()), pa.array(h, pa.string()), pa.array(units, pa.binary())], names=["vec_id", "h", "unit"])

    return vectors.select("vec_id", vector).mapInArrow(run, "vec_id long, h string, unit binary")


def _matrix(units: pa.Array, kind=np.float64) -> np.ndarray:
    return np.stack([np.frombuffer(u.as_buffer(), np.float64) for u in units]).astype(kind)


def _start(nodes: DataFrame, count: int, first_table: int, size: int) -> DataFrame:
    """Edges (a, b, s) between nodes of equal hyperplane signs, from blocks of near rows of each bucket."""
    bits = int(np.clip(np.ceil(np.log2(max(2, count) / 32)), 3, 40))

    def keys(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                dims = np.array([len(u.as_buffer()) // 8 for u in part.column("unit")])
                for d in np.unique(dims):
                    sub = part.filter(pa.array(dims == d))
                    x = _matrix(sub.column("unit"))
                    for t in range(first_table, first_table + TABLES):
                        planes = np.random.default_rng([t, int(d)]).standard_normal((int(d), bits + 1))
                        side = x @ planes
                        bucket = ((side[:, :bits] > 0) @ (1 << np.arange(bits, dtype=np.int64))) * 64 + t % 64
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d, np.int32)), pa.array(bucket), pa.array(side[:, bits]), sub.column("node"), sub.column("unit")], names=["dim", "bucket", "side", "node", "unit"])

    def near(batches):
        held: list[pa.RecordBatch] = []
        key = None

        def best(run: pa.Table):
            node = run.column("node").to_numpy()
            x = _matrix(run.column("unit").combine_chunks(), np.float32)
            s = x @ x.T
            np.fill_diagonal(s, -2)
            k = min(size, len(node) - 1)
            top = np.argpartition(-s, k - 1, axis=1)[:, :k]
            got = np.take_along_axis(s, top, axis=1)
            i, j = np.nonzero(got >= FLOOR)
            return pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(node[top[i, j]]), pa.array(got[i, j].astype(np.float64))], names=["a", "b", "s"])

        for batch in batches:
            at, n = 0, batch.num_rows
            dim, bucket = batch.column("dim").to_numpy(), batch.column("bucket").to_numpy()
            cuts = np.flatnonzero((dim[1:] != dim[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            for to in [*cuts.tolist(), n]:
                if key != (dim[at], bucket[at]):
                    if sum(b.num_rows for b in held) > 1:
                        yield best(pa.Table.from_batches(held))
                    held, key = [], (dim[at], bucket[at])
                while at < to:
                    room = CHUNK - sum(b.num_rows for b in held)
                    take = min(room, to - at)
                    held.append(batch.slice(at, take))
                    at += take
                    if take == room:
                        run = pa.Table.from_batches(held)
                        yield best(run)
                        held = [b for b in run.slice(CHUNK // 2).to_batches()]  # halves overlap
        if sum(b.num_rows for b in held) > 1:
            yield best(pa.Table.from_batches(held))

    spread = nodes.select("node", "unit").mapInArrow(keys, "dim int, bucket long, side double, node long, unit binary")
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By range of bucket and side, so a bucket that holds much of the data lies in many partitions.
    rows = spread.repartitionByRange(n, "dim", "bucket", "side", "node").sortWithinPartitions("dim", "bucket", "side", "node")
    return rows.mapInArrow(near, "a long, b long, s double")


def _cosines(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b, s) of pairs (a, b), in doubles."""
    left = nodes.select(F.col("node").alias("a"), F.col("unit").alias("ua"))
    right = nodes.select(F.col("node").alias("b"), F.col("unit").alias("ub"))

    def run(batches):
        for batch in batches:
            same = [len(x.as_buffer()) == len(y.as_buffer()) for x, y in zip(batch.column("ua"), batch.column("ub"), strict=True)]
            batch = batch.filter(pa.array(same, pa.bool_()))
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = np.concatenate([np.frombuffer(u.as_buffer(), np.float64) for u in part.column("ua")])
                y = np.concatenate([np.frombuffer(u.as_buffer(), np.float64) for u in part.column("ub")])
                size = np.array([len(u.as_buffer()) // 8 for u in part.column("ua")])
                s = np.add.reduceat(x * y, np.cumsum(size) - size)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(s)], names=["a", "b", "s"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ua", "ub").mapInArrow(run, "a long, b long, s double")


def _refine(nodes: DataFrame, edges: DataFrame, scratch: Scratch, name: str, threshold: float) -> DataFrame:
    """The edges (a, b, s, turn), each node's list at most as long as it may be, after rounds of joins."""

    def shorten(e: DataFrame, turn: int) -> DataFrame:
        """Of a node's edges the best; a list of links alone is twice as long each round, up to LONGEST."""
        longest = min(LONGEST, LIST << turn)
        by = Window.partitionBy("a").orderBy(F.desc("s"), "b")
        ranked = e.withColumn("rank", F.row_number().over(by))
        return ranked.where((F.col("rank") <= LIST) | ((F.col("s") >= threshold) & (F.col("rank") <= longest))).drop("rank")

    both = edges.select("a", "b", "s").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")).dropDuplicates(["a", "b"])
    lists = scratch.write(shorten(both.withColumn("turn", F.lit(0)), 0), f"{name}-0")
    for turn in range(1, ROUNDS + 1):
        back = lists.select(F.col("b").alias("a"), F.col("a").alias("b"), "turn")
        # From a node, or from one that lists it, to what its neighbour lists: a hub brings as many pairs as it has neighbours, not their square.
        hop1 = lists.select("a", "b", "turn").union(back).groupBy("a", "b").agg(F.min("turn").alias("t1"))
        hop2 = lists.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("turn").alias("t2"))
        reach = hop1.join(hop2, "b").where((F.col("a") != F.col("c")) & ((F.col("t1") == turn - 1) | (F.col("t2") == turn - 1)))
        pairs = reach.select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b")).distinct()
        known = lists.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        fresh = _cosines(pairs.join(known, ["a", "b"], "left_anti"), nodes).where(F.col("s") >= FLOOR)
        fresh = fresh.select("a", "b", "s").union(fresh.select(F.col("b").alias("a"), F.col("a").alias("b"), "s")).withColumn("turn", F.lit(turn))
        step = scratch.write(shorten(lists.union(fresh), turn), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
        lists = step
        if not lists.where(F.col("turn") == turn).limit(1).count():
            break
    return lists


def _compare_all(nodes: DataFrame, scratch: Scratch, threshold: float) -> DataFrame:
    """Every node (node, component, weight, unit) compared with every other: rows (a, b, linked).

    Rows with ``linked`` say how much weight node ``a`` links with; the others are links between components ``a`` and
    ``b``. Chunks of nodes are broadcast one after the other and all nodes stream past, so nothing is shuffled and no
    group is one task's. Single precision decides but for pairs so near the threshold that doubles have to.
    """
    count, size = nodes.agg(F.count("*"), F.sum(F.length("unit"))).first()
    chunks = max(1, -(-count // (BLOCK * BLOCKS)), -(-(size or 0) // CHUNK_BYTES))
    schema = "a long, b long, linked long"
    for c in range(chunks):
        by: dict[int, list] = {}
        for r in nodes.where(F.pmod(F.xxhash64("node"), F.lit(chunks)) == c).collect():
            by.setdefault(len(r["unit"]), []).append(r)
        held = {d: (*(np.array([r[k] for r in rs], np.int64) for k in ("node", "component", "weight")), np.stack([np.frombuffer(r["unit"], np.float64) for r in rs])) for d, rs in by.items()}
        book = nodes.sparkSession.sparkContext.broadcast(held)

        def run(batches, book=book):
            single = {d: q.astype(np.float32).T.copy() for d, (*_, q) in book.value.items()}
            for batch in batches:
                sizes = np.array([len(u.as_buffer()) for u in batch.column("unit")])
                for d, (who, label, weight, q) in book.value.items():
                    part = batch.filter(pa.array(sizes == d))
                    slack = (d // 8 + 4) * 2.0**-23
                    rows = max(1, TILE // len(who))
                    for at in range(0, part.num_rows, rows):
                        p = part.slice(at, rows)
                        node, mine = p.column("node").to_numpy(), p.column("component").to_numpy()
                        x = _matrix(p.column("unit"))
                        s = x.astype(np.float32) @ single[d]
                        i, j = np.divmod(np.flatnonzero(s >= np.float32(threshold - slack)), len(who))
                        near = np.flatnonzero(s[i, j] < threshold + slack)
                        ok = node[i] != who[j]
                        for k in range(0, len(near), 4096):
                            n = near[k : k + 4096]
                            ok[n] &= (x[i[n]] * q[j[n]]).sum(axis=1) >= threshold
                        i, j = i[ok], j[ok]
                        sums = np.zeros(len(node), np.int64)
                        np.add.at(sums, i, weight[j])
                        some = np.flatnonzero(sums)
                        apart = mine[i] != label[j]
                        one, two = mine[i[apart]], label[j[apart]]
                        join = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1), axis=0)
                        none = [None]
                        a = pa.array(np.concatenate([node[some], join[:, 0]]))
                        b = pa.array(none * len(some) + join[:, 1].tolist(), pa.int64())
                        linked = pa.array(sums[some].tolist() + none * len(join), pa.int64())
                        yield pa.RecordBatch.from_arrays([a, b, linked], names=["a", "b", "linked"])

        scratch.write(nodes.mapInArrow(run, schema), f"compared/chunk={c}")
        book.destroy()
    return nodes.sparkSession.read.schema(schema).parquet(*(scratch.path(f"compared/chunk={c}") for c in range(chunks)))


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vector: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id and the vector; other columns are left aside).

    Rows whose vector is null, empty, zero or holds null or non-finite parts link with nothing, as do vectors of other
    lengths. Equal vectors link; repeated rows are vectors of their own. Rows without an id count as links but lend no
    component its id, and aren't kept. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = scratch.write(unit_table(vectors, vector), "units")
    nodes = rows.where("h is not null").groupBy("h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("unit").alias("unit"))
    nodes = scratch.write(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    count = nodes.count()
    edges = _refine(nodes, _start(nodes, count, 0, LIST), scratch, "lists", threshold)
    links = _cosines(edges.where(F.col("s") >= threshold - 1e-4).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), nodes).where(F.col("s") >= threshold)
    labels = components(links, scratch, "components")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = nodes.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    placed = scratch.write(placed.select("node", "component", "weight", "unit").repartition(n, "node"), "placed")
    compared = _compare_all(placed, scratch, threshold)
    counted = compared.where("linked is not null").groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
    joined = components(compared.where("linked is null").select("a", "b"), scratch, "joined").select(F.col("node").alias("component"), F.col("component").alias("to"))
    labels = placed.select("node", "component").join(joined, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    of = nodes.select("node", "h", "rep", "weight").join(labels, "node").join(counted, "node", "left")
    least = of.where("component is not null").groupBy("component").agg(F.min("rep").alias("least"))
    of = of.join(least, "component", "left").select("h", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    linked = rows.where("h is not null").select("vec_id", "h").join(of, "h").select("vec_id", "n_links", "component_id")
    alone = rows.where("h is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return scratch.finish(linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))


def op3_nn_descent(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
