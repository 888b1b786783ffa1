"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of the target (documents labelled good) and one of all raw text, give
each document the log of its importance weight: the sum over its n-grams of log p_target / p_raw. A Gumbel variable
from the document's own hash is added, and the k largest sums are the sample, which is sampling without replacement in
proportion to the weights.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, kth_largest, table
from .shingles import BASE, in_portions, mix, ngrams, text_bytes, word_hashes
from .words import slices

#: Bytes of texts that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1_000_000
#: Buckets of the hashed n-grams.
BUCKETS = 1 << 16
#: Labelled rows of each class that the target model and the cut are fitted on, those of the least hash.
MAX_LABELLED = 20_000
#: The share of good labelled documents that the size of the sample has to keep.
KEEP_GOOD = 0.998
#: Pseudo-counts of each bucket: with few occurrences a bucket says little.
SMOOTH = 5.0
#: Most that one n-gram can say for or against, as a log.
CLIP = 3.0
SEED = 11


def document_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, bucket) of every n-gram: words as written, pairs of them, and what stands beside a word's letters.

    A pair of equal words is one n-gram whatever the word is, as is the shape of a word (its marks and letter case).
    """
    raw, n = word_hashes(texts, lower=False, plain=False)
    pairs, n2 = ngrams(raw, n, 2)
    starts = np.cumsum(n) - n
    at = np.arange(len(pairs)) - np.repeat(np.cumsum(n2) - n2, n2) + np.repeat(starts, n2)
    again = raw[at] == raw[at + 1] if len(pairs) else np.zeros(0, bool)
    pairs = np.where(again, np.uint64(1), pairs)
    shapes, n3 = shape_hashes(texts)
    runs, n4 = ngrams(shapes, n3, 3)
    owner = np.arange(len(n))
    own = np.concatenate([np.repeat(owner, k) for k in (n, n2, n3, n4)])
    salt = np.concatenate([np.full(len(x), s, np.uint64) for s, x in enumerate((raw, pairs, shapes, runs), 1)])
    return own, (mix(np.concatenate([raw, pairs, shapes, runs]) ^ (salt << np.uint64(56))) % np.uint64(BUCKETS)).astype(np.int64)


def _shape_classes() -> np.ndarray:
    """Of a byte: 0 white space, 1 small letter or other character, 2 capital, 3 digit, else the mark itself."""
    out = np.arange(256, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        out[b] = 0 if c in " \t\n\r\f\v" else 1 if b >= 128 or c.islower() else 2 if c.isupper() else 3 if c.isdigit() else b
    return out


SHAPE = _shape_classes()


def shape_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each word's shape, runs of a class counted once, and number of words of each text)."""
    return in_portions(*text_bytes(texts, lower=False), SHAPE == 0, _hash_shapes)


def _hash_shapes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kind = SHAPE[raw]
    fresh = np.ones(len(kind), bool)
    fresh[1:] = kind[1:] != kind[:-1]
    fresh[at[:-1][at[:-1] < len(kind)]] = True
    where = np.flatnonzero(fresh & (kind > 0))
    k = kind[where].astype(np.uint64)
    starts_word = np.ones(len(where), bool)
    starts_word[1:] = (kind[where[1:] - 1] == 0) | (np.searchsorted(at, where[1:], side="right") != np.searchsorted(at, where[:-1], side="right"))
    first = np.flatnonzero(starts_word)
    if not len(first):
        return np.zeros(0, np.uint64), np.zeros(len(at) - 1, np.int64)
    place = np.arange(len(where)) - np.repeat(first, np.diff(np.append(first, len(where))))
    powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(int(place.max()) + 1, BASE, np.uint64))])
    sums = np.add.reduceat((k + np.uint64(1)) * powers[place], first)
    return mix(sums), np.diff(np.searchsorted(where[first], at))


def count_models(docs: DataFrame, good: list[int], buckets: int = BUCKETS) -> np.ndarray:
    """Counts (2, buckets): of the target, which is the documents of the ids given, and of all documents.

    Each task sums its documents first, so at most ``buckets`` rows of a task are shuffled and as many reach the driver.
    """
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(good, np.int64)))

    def run(batches):
        ids = wanted.value
        sums = np.zeros((2, buckets), np.int64)
        for batch in batches:
            for s in slices(batch, "text", SLICE_BYTES):
                own, bucket = document_buckets(s.column("text"))
                sums[1] += np.bincount(bucket, minlength=buckets)
                doc = s.column("doc_id").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
                sums[0] += np.bincount(bucket[np.isin(doc, ids)[own]], minlength=buckets)
        at = np.flatnonzero(sums[1])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["bucket", "target", "raw"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    out = np.zeros((2, buckets), np.int64)
    for r in rows.collect():
        out[:, r["bucket"]] = r["target"], r["raw"]
    return out


class Models:
    """Counts of the target and of all raw text by bucket, and the ids of the target's documents."""

    def __init__(self, counts: np.ndarray, good: list[int]):
        self.target, self.raw = counts.astype(np.float64)
        self.share = self.target.sum() / max(1.0, self.raw.sum())
        self.good = np.sort(np.array(good, np.int64))

    def log_weights(self, own: np.ndarray, bucket: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The sum of log p_target / p_raw over each document's n-grams.

        A document's own counts are left out of both models, so that labelled and other documents are judged alike and
        an n-gram that no other document has says nothing.
        """
        key, times = np.unique(own * len(self.raw) + bucket, return_counts=True)
        at, b = key // len(self.raw), key % len(self.raw)
        target = np.maximum(self.target[b] - times * np.isin(doc, self.good)[at], 0) + SMOOTH
        raw = np.maximum(self.raw[b] - times, 0) * self.share + SMOOTH
        return np.bincount(at, weights=times * np.clip(np.log(target / raw), -CLIP, CLIP), minlength=len(doc))


def _gumbel(key: np.ndarray) -> np.ndarray:
    u = ((key >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53
    return -np.log(-np.log(u))


def scores(part: pa.RecordBatch, models: Models, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(log weight, log weight plus Gumbel noise) of each row. The noise depends on doc_id, text and seed alone, so a task that runs again draws it again."""
    texts = part.column("text")
    own, bucket = document_buckets(texts)
    doc = part.column("doc_id").cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    weight = models.log_weights(own, bucket, doc)
    words, n = word_hashes(texts, lower=False, plain=False)
    sums = np.zeros(part.num_rows, np.uint64)
    np.add.at(sums, np.repeat(np.arange(len(n)), n), words)
    return weight, weight + _gumbel(mix(mix(doc.astype(np.uint64) + np.uint64(seed)) ^ sums))


def importance(docs: DataFrame, models: Models, seed: int = SEED) -> DataFrame:
    """doc_id, log_weight and sort_key of each row."""
    book = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        for batch in batches:
            for s in slices(batch, "text", SLICE_BYTES):
                weight, key = scores(s, book.value, seed)
                yield pa.RecordBatch.from_arrays([s.column("doc_id").cast(pa.int64()), pa.array(weight), pa.array(key)], names=["doc_id", "log_weight", "sort_key"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, log_weight double, sort_key double")


def labelled_ids(labels: DataFrame, quality: int, most: int = MAX_LABELLED) -> list[int]:
    rows = labels.where((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return [r["doc_id"] for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]


class Sampler:
    """A fitted resampler: the models and the least sort_key that is in the sample (None: all are)."""

    def __init__(self, models: Models, cut: float | None):
        self.models, self.cut = models, cut


def fit(docs: DataFrame, labels: DataFrame, k: int | None = None) -> tuple[Sampler, DataFrame]:
    """The sampler, and the scored rows it was cut from.

    Without ``k`` the sample has as many documents as have a log weight of at least that of the worst of the best
    99.8 % of the good labelled ones, but no lower than most bad ones lie where both classes can be told apart.
    Without good labels nothing is known, and all rows are the sample.
    """
    spark = docs.sparkSession
    good, bad = labelled_ids(labels, 1), labelled_ids(labels, 0)
    models = Models(count_models(docs, good) if good else np.zeros((2, BUCKETS)), good)
    scored = Scratch(spark, "quality").write(importance(docs, models), "scored")
    if k is None:
        if not good:
            return Sampler(models, None), scored
        # Scores of at most MAX_LABELLED rows of a class; a doc_id of many rows counts once.
        ids = spark.createDataFrame([(i, 1) for i in good] + [(i, 0) for i in bad], "doc_id long, good int")
        rows = scored.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "good").agg(F.min("log_weight").alias("w")).select("good", "w").collect()
        of_good, of_bad = (np.sort([r["w"] for r in rows if r["good"] == g]) for g in (1, 0))
        if not len(of_good):
            return Sampler(models, None), scored
        floor = float(of_good[int((1 - KEEP_GOOD) * len(of_good))])
        if len(of_bad):
            # Down to the middle of the gap below, if there is one, so that good documents unlike the labelled ones stay.
            below = of_bad[of_bad < floor]
            floor = (floor + float(below[-1])) / 2 if len(below) else floor
        k = scored.where(F.col("log_weight") >= floor).count()
    return Sampler(models, kth_largest(scored, "sort_key", k) if k else float("inf")), scored


def classify(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """doc_id, log_weight, sort_key, kept of each row of ``docs`` (doc_id, text; other columns are left aside).

    Null and empty texts weigh 0. Equal rows get equal keys, and all rows at the cut are kept. Repeated and null ids
    stay. An empty table gives no rows.
    """
    sampler, scored = fit(docs, labels, k)
    kept = F.lit(True) if sampler.cut is None else F.col("sort_key") >= F.lit(sampler.cut)
    return scored.select("doc_id", "log_weight", "sort_key", kept.alias("kept"))


def keep_sample(docs: DataFrame, labels: DataFrame, k: int | None = None) -> DataFrame:
    """The rows of ``docs`` that are in the sample, all columns; scored again where they lie, without a join."""
    sampler, _ = fit(docs, labels, k)
    if sampler.cut is None:
        return docs
    book = docs.sparkSession.sparkContext.broadcast((sampler.models, sampler.cut))

    def run(batches):
        models, cut = book.value
        for batch in batches:
            for s in slices(batch, "text", SLICE_BYTES):
                yield s.filter(pa.array(scores(s, models, SEED)[1] >= cut))

    return docs.mapInArrow(run, docs.schema)


def op4_importance_resampling(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
