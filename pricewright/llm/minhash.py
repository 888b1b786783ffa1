"""Near duplicates by Order MinHash.

A text is its sequence of five-word shingles, each with the number of its occurrence. One sketch of an Order MinHash
keeps the few shingles that a random order puts first, in the order of the text, so two texts agree on a sketch only if
they share shingles in the same order. Texts that agree on any sketch are candidates; a banded alignment of both whole
shingle sequences decides. Exact copies are one text from the start.

Similarity of two texts: m / (x + y - m), where x and y are their numbers of shingles and m is the length of the longest
common subsequence; without moved passages that is the Jaccard index of the labelled shingles.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, fresh, table
from .graph import components
from .shingles import BASE, mix, ngrams, word_hashes
from .words import slices

WORDS, SIMILARITY = 5, 0.8
#: Bytes of texts that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1_000_000
#: (least shingles, most shingles, kept shingles of a sketch, sketches). The ranges overlap by more than a fifth, so two similar texts always share one.
SIZES = ((1, 60, 3, 24), (40, 1 << 62, 6, 40))
#: A task looks for a sketch's first shingles among about so many per text before it looks at all of them.
NARROW = 28
#: Buckets of so few members are aligned pair by pair; larger ones in blocks of so many members.
FEW, BLOCK = 8, 512
#: Shingles and columns that a task holds at once while it counts what members of a block have in common.
COUNTED, COLUMNS = 2_000_000, 4096
#: Shingles that a task keeps ready while it aligns the pairs of two blocks.
HELD_SHINGLES = 4_000_000
#: Rows of an alignment after which columns behind the band are dropped.
DROP = 2048
#: A shingle comes up often from so many times on, and from the length of the text over this number; so few have a number of their own.
OFTEN, MASKS = 16, 2048
#: Candidates up to this many are broadcast to the scan of the texts; more are joined by a shuffle.
BROADCAST_ROWS = 200_000


def labelled_shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(shingle with its occurrence number, number of shingles) of each text; fewer than five words are one shingle, none have none."""
    words, n = word_hashes(texts)
    grams, k = ngrams(words, n, WORDS)
    if short := np.flatnonzero((n > 0) & (k == 0)).tolist():
        starts, at = np.cumsum(n) - n, np.cumsum(k)
        whole = [np.uint64(0)] * len(short)
        for i, t in enumerate(short):
            x = np.zeros(1, np.uint64)
            for w in words[starts[t] : starts[t] + n[t]]:
                x = x * BASE + w
            whole[i] = mix(x ^ np.uint64(n[t]))[0]
        grams = np.insert(grams, at[short], np.array(whole, np.uint64))
        k = k.copy()
        k[short] = 1
    owner = np.repeat(np.arange(len(k)), k)
    order = np.lexsort((grams, owner))
    g, o = grams[order], owner[order]
    fresh = np.ones(len(g), bool)
    fresh[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    first = np.flatnonzero(fresh)
    nth = np.empty(len(g), np.uint64)
    nth[order] = np.arange(len(g)) - np.repeat(first, np.diff(np.append(first, len(g))))
    return mix(grams + nth * BASE), k


def sketches(shingles: np.ndarray, k: np.ndarray) -> list[list[int]]:
    """The bucket keys of each text."""
    out: list[list[int]] = [[] for _ in k]
    starts = np.cumsum(k) - k
    for kind, (least, most, kept, count) in enumerate(SIZES):
        texts = np.flatnonzero((k >= least) & (k < most))
        if not len(texts):
            continue
        n = k[texts]
        total = int(n.sum())
        first = np.cumsum(n) - n
        x = shingles[np.arange(total) + np.repeat(starts[texts] - first, n)]
        owner = np.repeat(np.arange(len(texts)), n)
        limit = np.minimum(NARROW * (2.0**64 / n), 2.0**64 - 4096).astype(np.uint64)[owner]
        keys = np.zeros((len(texts), count), np.uint64)
        need = np.minimum(n, kept)
        for j in range(count):
            salt = mix(np.array([1 + j + 1000 * kind], np.uint64))[0]
            v = (x ^ salt) * (salt | np.uint64(1))
            near = np.flatnonzero(v <= limit)
            have = np.bincount(owner[near], minlength=len(texts))
            if len(lack := np.flatnonzero(have < need)):
                near = np.union1d(near, np.flatnonzero(np.isin(owner, lack)))
                have = np.bincount(owner[near], minlength=len(texts))
            o = owner[near]
            near = near[np.lexsort((v[near], o))]
            rank = np.arange(len(near)) - np.repeat(np.cumsum(have) - have, have)
            chosen = np.sort(near[rank < np.repeat(need, have)])
            at = np.cumsum(need) - need
            place = np.arange(len(chosen)) - np.repeat(at, need)
            powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(kept, BASE, np.uint64))])
            keys[:, j] = mix(np.add.reduceat(x[chosen] * powers[place], at) ^ salt)
        for t, row in zip(texts.tolist(), keys.astype(np.int64).tolist(), strict=True):
            out[t] += row
    return out


def sketch_table(docs: DataFrame) -> DataFrame:
    """doc_id, h (digest of the text), n (shingles) and keys of each row."""

    def run(batches):
        for batch in batches:
            for s in slices(batch, "text", SLICE_BYTES):
                x, k = labelled_shingles(s.column("text"))
                keys = pa.array(sketches(x, k), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([s.column("doc_id").cast(pa.int64()), s.column("h"), pa.array(k.astype(np.int64)), keys], names=["doc_id", "h", "n", "keys"])

    return docs.select("doc_id", digest("text").alias("h"), "text").mapInArrow(run, "doc_id long, h string, n long, keys array<long>")


def digest(text):
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def shingle_sequence(words: np.ndarray) -> np.ndarray:
    """The shingles of one text (without occurrence numbers) from its words."""
    if len(words) < WORDS:
        return mix(np.array([len(words), *words], np.uint64).cumsum(dtype=np.uint64)[-1:]) if len(words) else words
    return ngrams(words, np.array([len(words)]), WORDS)[0]


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> float:
    """The similarity of two shingle sequences if it is at least ``similarity``, else 0.

    The longest common subsequence, a row at a time in the bits of one number. So many matches are needed that no
    matched pair can lie further off the diagonal than the band, so cells outside it aren't looked at.
    """
    x, y = len(a), len(b)
    if not x or not y:
        return 0.0
    need = int(np.ceil(similarity * (x + y) / (1 + similarity) - 1e-9))
    if need > min(x, y):
        return 0.0
    head = 0
    m = min(x, y)
    if (same := a[:m] == b[:m]).all():
        head = m
    else:
        head = int(np.argmin(same))
    tail = 0
    if head < m:
        back = a[::-1][: m - head] == b[::-1][: m - head]
        tail = len(back) if back.all() else int(np.argmin(back))
    p, q = a[head : x - tail], b[head : y - tail]
    matched = head + tail
    if len(p) and len(q):
        u, cu = np.unique(p, return_counts=True)
        v, cv = np.unique(q, return_counts=True)
        common, iu, iv = np.intersect1d(u, v, assume_unique=True, return_indices=True)
        if matched + int(np.minimum(cu[iu], cv[iv]).sum()) < need:
            return 0.0
        matched += _banded_lcs(p[:], q[:], max(x, y) - need, set(common.tolist()))
    return matched / (x + y - matched) if matched >= need else 0.0


def _banded_lcs(p: np.ndarray, q: np.ndarray, width: int, common: set[int]) -> int:
    """Length of the longest common subsequence whose matches lie within the band.

    The number holds the columns from ``low`` on, a zero for each that is matched so far. Columns that the band has
    left behind are counted and dropped, so it is about as long as the band is wide, however long the texts are.
    Columns of a shingle that comes up often, as in a text that repeats itself, are the bits of a number too, to which
    those that the band reaches are added; so a row costs a few operations on numbers of the band's width.
    """
    often, masks = max(OFTEN, len(q) // MASKS), {}
    where: dict[int, list[int]] = {}
    for j, c in enumerate(q.tolist()):
        if c in common:
            where.setdefault(c, []).append(j)
    low, columns, matched = 0, min(len(q), 2 * width + DROP), 0
    row = (1 << columns) - 1
    for i, c in enumerate(p.tolist()):
        if i - width - low >= DROP:
            gone = min(i - width - low, columns)
            matched += gone - (row & ((1 << gone) - 1)).bit_count()
            row >>= gone
            low, columns = low + gone, columns - gone
            more = min(len(q), i + width + DROP) - (low + columns)
            if more > 0:
                row |= ((1 << more) - 1) << columns
                columns += more
        at = where.get(c)
        if at:
            hits = 0
            if len(at) > often:
                known, since, upto = masks.get(c) or (0, low, bisect_left(at, low))
                known >>= low - since
                to = bisect_right(at, i + width, upto)
                for j in at[upto:to]:
                    known |= 1 << (j - low)
                masks[c] = known, low, to
                behind = max(0, i - width - low)
                hits = known >> behind << behind
            else:
                if len(at) > 1:
                    at = at[bisect_left(at, i - width) : bisect_right(at, i + width)]
                for j in at:
                    if -width <= j - i <= width:
                        hits |= 1 << (j - low)
            u = row & hits
            if u:
                row = ((row + u) | (row - u)) & ((1 << columns) - 1)
    return matched + columns - row.bit_count()


def _verify(pairs: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b, similarity) of the pairs whose alignment reaches ``similarity``."""
    left = words.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    rows = pairs.join(right, "b").join(left, "a").select("a", "b", "wa", "wb")

    def run(batches):
        known: dict = {}
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            got = []
            for i in range(batch.num_rows):
                if a[i] not in known:
                    known.clear()
                    known[a[i]] = shingle_sequence(np.frombuffer(batch.column("wa")[i].as_buffer(), np.uint64))
                s = aligned(known[a[i]], shingle_sequence(np.frombuffer(batch.column("wb")[i].as_buffer(), np.uint64)), similarity)
                if s:
                    got.append((a[i], b[i], s))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got, strict=True)], names=["a", "b", "similarity"])

    return rows.mapInArrow(run, "a long, b long, similarity double")


def _in_common(left: list, right: list) -> np.ndarray:
    """How many labelled shingles each text of ``left`` has in common with each of ``right``; all are words as bytes."""
    sizes = [len(w) // 8 for w in (*left, *right)]
    parts = max(1, -(-sum(sizes) // COUNTED))
    out = np.zeros((len(left), len(right)), np.float32)
    for part in range(parts):
        kept = []
        for w in (*left, *right):
            g = np.sort(shingle_sequence(np.frombuffer(w, np.uint64)))
            g = g[g % np.uint64(parts) == part]
            kept.append(mix(g + (np.arange(len(g)) - np.searchsorted(g, g)).astype(np.uint64) * BASE))
        owner = np.repeat(np.arange(len(kept)), [len(g) for g in kept])
        _, column = np.unique(np.concatenate(kept), return_inverse=True)
        here, there = (np.bincount(column[x], minlength=len(column)) > 0 for x in (owner < len(left), owner >= len(left)))
        number = np.cumsum(here & there) - 1
        use = (here & there)[column]
        owner, column = owner[use], number[column[use]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, [first, first + COLUMNS])
            x = np.zeros((len(kept), COLUMNS), np.float32)
            x[owner[a:b], column[a:b] - first] = 1
            out += x[: len(left)] @ x[len(left) :].T
    return out


def _crowded(rows: DataFrame, nodes: DataFrame, words: DataFrame, similarity: float) -> DataFrame:
    """Links among members of large buckets that aren't connected, of all pairs of fitting sizes.

    Texts that share a passage meet in large buckets and are alike in little else. A bucket is dealt into blocks, and each
    pair of blocks is one piece of work that aligns its pairs where they lie, so no more rows are made than members
    have blocks. A pair that meets in many buckets is aligned in that of the first sketch on which it agrees, unless
    the two have too few shingles in common, in whatever order, to be alike.
    """
    rows = rows.withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("k", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "mine", "node", "n", "component")
    rows = rows.join(nodes.select("node", "keys").join(words, "node"), "node")

    def compare(run: pa.Table):
        bucket = run.column("k")[0].as_py()
        node, n, mine, label = (run.column(c).to_numpy() for c in ("node", "n", "mine", "component"))
        i, j = (np.flatnonzero(mine == run.column(c)[0].as_py()) for c in ("lo", "hi"))
        keys = run.column("keys").to_pylist()
        seen, here = (np.zeros((len(i), len(j)), bool) for _ in range(2))
        for kind, (least, most, _, count) in enumerate(SIZES):
            have = (n >= least) & (n < most)
            # Keys of a text are those of its first range, then those of its last; others get numbers that equal nothing.
            x = np.array([(k[:count] if kind == 0 else k[-count:]) if ok else [0] * count for k, ok in zip(keys, have, strict=True)], np.int64).reshape(len(keys), count)
            both = have[i][:, None] & have[j]
            for c in range(count):
                equal = (x[i, c][:, None] == x[j, c]) & both
                here |= equal & ~seen & (x[i, c] == bucket)[:, None]
                seen |= equal
        agree = here & (label[i][:, None] != label[j]) & (node[i][:, None] < node[j] if run.column("lo")[0] == run.column("hi")[0] else True)
        agree &= np.minimum(n[i][:, None], n[j]) >= (similarity - 1e-9) * np.maximum(n[i][:, None], n[j])
        texts, known, size, found = run.column("words"), {}, 0, []
        if agree.any():
            left, right = (np.flatnonzero(agree.any(axis=x)) for x in (1, 0))
            common = _in_common([texts[r].as_buffer() for r in i[left].tolist()], [texts[r].as_buffer() for r in j[right].tolist()])
            need = np.ceil(similarity * (n[i[left]][:, None] + n[j[right]]) / (1 + similarity) - 1e-9)
            agree[np.ix_(left, right)] &= common >= need

        def sequence(r: int) -> np.ndarray:
            nonlocal size
            if r not in known:
                if size > HELD_SHINGLES:
                    known.clear()
                    size = 0
                known[r] = shingle_sequence(np.frombuffer(texts[r].as_buffer(), np.uint64))
                size += len(known[r])
            return known[r]

        for u, v in zip(*np.nonzero(agree), strict=True):
            r, t = int(i[u]), int(j[v])
            if alike := aligned(sequence(r), sequence(t), similarity):
                found.append((min(node[r], node[t]), max(node[r], node[t]), alike))
        one, two, alike = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(alike, pa.float64())], names=["a", "b", "similarity"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        key = None
        for batch in batches:
            k, lo, hi = (batch.column(c).to_numpy() for c in ("k", "lo", "hi"))
            cuts = np.flatnonzero((k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            at = 0
            for to in [*cuts.tolist(), batch.num_rows]:
                if (now := (k[at], lo[at], hi[at])) != key:
                    if held:
                        yield compare(pa.Table.from_batches(held))
                    held, key = [], now
                held.append(batch.slice(at, to - at))
                at = to
        if held:
            yield compare(pa.Table.from_batches(held))

    group = ["k", "lo", "hi"]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, *group).sortWithinPartitions(*group, "node").mapInArrow(run, "a long, b long, similarity double")


def _word_table(docs: DataFrame, nodes: DataFrame, rows: int) -> DataFrame:
    """node and words (64-bit hashes as bytes) of the given nodes (node, h, rep), one row each."""
    texts = docs.select("doc_id", "text", digest("text").alias("h"))
    wanted = nodes.select("node", F.col("h").alias("h2"), "rep")
    wanted = F.broadcast(wanted) if rows <= BROADCAST_ROWS else wanted
    found = texts.join(wanted, (F.col("h") == F.col("h2")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")

    def run(batches):
        for batch in batches:
            for s in slices(batch, "text", SLICE_BYTES):
                words, n = word_hashes(s.column("text"))
                at = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays([s.column("node"), pa.array([words[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["node", "words"])

    return found.mapInArrow(run, "node long, words binary").dropDuplicates(["node"])


def classify(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, h (digest of the text), class_id and first_h (the text of the class that stays) of each row of ``docs``.

    A class is what links of at least ``similarity`` connect, exact copies included; class_id is its least doc_id, and
    first_h the text that has it, or the least digest if no row of the class has an id. Null and empty texts are copies of each other; texts without any word or with
    fewer than five match on all of them. Rows without an id have the class of their text; of repeated rows each has
    its own result row. An empty table gives no rows.

    Large groups cost no more than their size: copies are one node, and a bucket's members are aligned with one pivot
    first, the text that most others meet; only pairs that stay unconnected are looked at after that.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "minhash")
    rows = scratch.write(sketch_table(docs), "sketches")
    classes = rows.groupBy("h").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    classes = scratch.write(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    spread = classes.select("node", "n", F.explode("keys").alias("k"))
    shared = spread.groupBy("k").agg(F.count("*").alias("members")).where("members > 1")
    spread = scratch.write(spread.join(shared, "k"), "spread")
    # A bucket's pivot is its member that has most company in all buckets, so the text that many copies were made from.
    company = spread.groupBy("node").agg(F.sum("members").alias("company"))
    members = scratch.write(spread.join(company, "node"), "members")
    pivots = members.groupBy("k").agg(F.max_by(F.struct("node", "n"), F.struct(F.col("company"), -F.col("node"))).alias("p"))
    nodes = scratch.write(classes.join(company, "node").select("node", "h", "rep", "n", "keys"), "nodes")
    words = scratch.write(_word_table(docs, nodes, nodes.count()), "words")

    def fits(a: str, b: str):
        return F.least(a, b) >= F.lit(similarity - 1e-9) * F.greatest(a, b)

    pairs = members.join(pivots, "k").select(F.col("p.node").alias("a"), F.col("p.n").alias("na"), F.col("node").alias("b"), "n").where("a <> b").where(fits("na", "n")).select("a", "b").distinct()
    links = scratch.write(_verify(pairs, words, similarity), "links-pivots")
    labels = components(links, scratch, "first")
    placed = members.join(labels, "node", "left").select("k", "node", "n", "members", F.coalesce("component", "node").alias("component"))
    split = placed.groupBy("k").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("k")
    apart = scratch.write(placed.join(split, "k"), "apart")
    a = apart.where(F.col("members") <= FEW).select("k", F.col("node").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca"))
    b = apart.where(F.col("members") <= FEW).select("k", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    few = a.join(b, "k").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits("na", "nb")).select("a", "b")
    crowded = _crowded(apart.where(F.col("members") > FEW), nodes, words, similarity)
    links = scratch.write(links.union(_verify(few.distinct(), words, similarity)).union(crowded), "links")
    labels = components(links, scratch, "last")
    own = classes.select("node", "h", "rep").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = own.groupBy("component").agg(F.min("rep").alias("class_id"), F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "h")).alias("first"))
    of = own.join(of, "component").select("h", "class_id", F.col("first.h").alias("first_h"))
    return scratch.finish(rows.select("doc_id", "h").join(of, "h"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id and kept (the row has the id of its class) of each row; see ``classify``."""
    rows = classify(docs, similarity)
    return rows.select("doc_id", "class_id", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)).alias("kept"))


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, all columns of ``docs``: that of the least id, or of the least digest where no row has an id."""
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = classify(docs, similarity)
    stays = (F.col("h") == F.col("first_h")) & F.col("doc_id").eqNullSafe(F.col("class_id"))
    id2, h2, h, rank = fresh(docs, "pw_id", "pw_digest2", "pw_digest", "pw_rank")
    pair = [F.col("doc_id").alias(id2), F.col("h").alias(h2)]
    gone = found.where(~stays).select(*pair).distinct()
    repeated = scratch.write(found.where(stays).groupBy("doc_id", "h").count().where("count > 1").select(*pair), "repeated")
    same = F.col("doc_id").eqNullSafe(F.col(id2)) & (F.col(h) == F.col(h2))
    rows = docs.withColumn(h, digest("text")).join(gone, same, "left_anti")
    if repeated.limit(1).count():
        # Equal rows of the pair that stays: only they are ranked.
        first = Window.partitionBy("doc_id", h).orderBy(F.xxhash64(*docs.columns))
        twice = rows.join(repeated, same, "left_semi").withColumn(rank, F.row_number().over(first)).where(F.col(rank) == 1).drop(rank)
        rows = rows.join(repeated, same, "left_anti").union(twice)
    return rows.select(*docs.columns)


def op2_order_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
