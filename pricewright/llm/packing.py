"""Best-fit packing by length patterns.

Documents become pieces of at most ``width`` tokens. The histogram of their lengths (at most ``width`` numbers, however
many documents there are) is what the plan is made from: patterns of a few lengths that nearly fill a sequence are
enumerated, non-negative least squares fits how often each repeats, counts are rounded down to what is there, and the
residual is packed best-fit-decreasing, again on counts. Pieces then look up their place by length and rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read_local, table
from .words import encoder, slices

WIDTH = 4096
END_ID = 1
#: A fitted pattern leaves at most this share of a sequence empty.
WASTE = 1 / 64
#: As much may a pair leave empty.
PAIR_WASTE = 1 / 4
#: Patterns that are enumerated for each length, and sweeps of the fit.
PER_LENGTH, SWEEPS = 10, 25
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def enumerate_patterns(lengths: list[int], width: int, pairs: bool = False, per_length: int = PER_LENGTH) -> list[tuple[int, ...]]:
    """Patterns of two to four of the given lengths (ascending), each completed by the longest length that still fits.

    With ``pairs`` a length is also in a pair that leaves up to a quarter empty, so that the fit sees with what it may
    have to share a sequence when nothing better is left.
    """

    def best(space: int) -> int:
        i = bisect_right(lengths, space)
        return lengths[i - 1] if i else 0

    found = set()
    steps = [lengths[(len(lengths) - 1) * k // max(1, per_length - 1)] for k in range(per_length)] if lengths else []
    for first in lengths:
        if pairs and (last := best(width - first)) and first + last >= width * (1 - PAIR_WASTE):
            found.add((max(first, last), min(first, last)))
        for second in [0, *steps]:
            for third in (0, second):
                space = width - first - second - third
                if space > 0 and (last := best(space)):
                    pattern = tuple(sorted((x for x in (first, second, third, last) if x), reverse=True))
                    if sum(pattern) >= width * (1 - WASTE):
                        found.add(pattern)
    return sorted(found, key=lambda p: (-sum(p), p))


def fit_repeats(patterns: list[tuple[int, ...]], counts: dict[int, int], sweeps: int = SWEEPS) -> list[float]:
    """Non-negative least squares of pattern repeats to the histogram, by cyclic coordinate descent."""
    rest = {k: float(v) for k, v in counts.items()}
    columns = [[(x, p.count(x)) for x in dict.fromkeys(p)] for p in patterns]
    norms = [sum(m * m for _, m in c) for c in columns]
    x = [0.0] * len(patterns)
    for _ in range(sweeps):
        moved = 0.0
        for i, c in enumerate(columns):
            step = 0.0
            for length, m in c:
                step += m * rest[length]
            step = max(step / norms[i], -x[i])
            if step:
                x[i] += step
                moved = max(moved, abs(step))
                for length, m in c:
                    rest[length] -= m * step
        if moved < 0.25:
            break
    return x


def plan(counts: dict[int, int], width: int = WIDTH) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, repeats) that use every length exactly as often as it occurs: of two sets of patterns, rounded to the nearest or down, the fit that takes the fewest sequences."""
    return min((_fitted(counts, width, pairs, up) for pairs in (False, True) for up in (0.5, 0.0)), key=lambda plan: sum(n for _, n in plan))


def _fitted(counts: dict[int, int], width: int, pairs: bool, up: float) -> list[tuple[tuple[int, ...], int]]:
    left = {k: v for k, v in counts.items() if v > 0}
    out = [((width,), left.pop(width))] if width in left else []
    patterns = enumerate_patterns(sorted(left), width, pairs)
    fitted = fit_repeats(patterns, left)
    for p, x in sorted(zip(patterns, fitted, strict=True), key=lambda t: -t[1]):
        if n := min(int(x + up), *(left[k] // p.count(k) for k in p)):
            out.append((p, n))
            for k in p:
                left[k] -= n
    lengths = sorted(k for k, v in left.items() if v)
    while lengths:
        used: dict[int, int] = {}
        space, i = width, len(lengths)
        while i and space >= lengths[0]:
            k = lengths[i - 1]
            if take := min(space // k, left[k]):
                used[k] = take
                space -= take * k
            i = min(i - 1, bisect_right(lengths, space))
        n = min(left[k] // m for k, m in used.items())
        out.append((tuple(k for k, m in used.items() for _ in range(m)), n))
        for k, m in used.items():
            left[k] -= n * m
        lengths = [k for k in lengths if left[k]]
    return out


def places(planned: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, times in a sequence, offset), sorted: where a length's ranks go."""
    rows, sequence, rank = [], 0, defaultdict(int)
    for pattern, n in planned:
        offset = 0
        for length in dict.fromkeys(pattern):
            m = pattern.count(length)
            rows.append((length, rank[length], sequence, m, offset))
            rank[length] += n * m
            offset += m * length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut_pieces(docs: DataFrame, vocabulary: bytes, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """One row a piece, with its number among the pieces of its length in its task (``part``, ``nth``)."""
    book = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])

    def run(batches):
        enc, part = encoder(book.value), TaskContext.get().partitionId()
        seen = np.zeros(width + 1, np.int64)
        for batch in batches:
            for s in slices(batch, "text"):
                flat, size = enc.encode(s.column("text"))
                flat, size = np.insert(flat, np.cumsum(size), np.uint32(end_id)), size + 1
                n = -(-size // width)
                ends = np.cumsum(n)
                owner = np.repeat(np.arange(len(size)), n)
                piece = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
                start = piece * width
                length = np.minimum(size[owner] - start, width)
                at = (np.cumsum(size) - size)[owner] + start
                raw = flat.astype("<u4").tobytes()
                crc = [zlib.crc32(raw[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                kinds, first, many = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(first, many) + np.repeat(seen[kinds], many)
                seen[kinds] += many
                yield pa.RecordBatch.from_arrays([s.column("doc_id").take(pa.array(owner)).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(length), part), pa.int32()), pa.array(nth)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, vocabulary: bytes, width: int = WIDTH, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece.

    Needs ``doc_id`` and ``text`` (null: empty, so one piece with the end id); other columns are left aside. Repeated
    rows and null ids are documents like any other; ties in length are ranked by task and order. Empty: no rows.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.write(cut_pieces(docs, vocabulary, width, end_id), "pieces")
    # At most `width` rows come to the driver, and at most one row for each part and length goes through the window.
    per_part = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").count().withColumnRenamed("count", "n").collect()}
    where = docs.sparkSession.sparkContext.broadcast(places(plan(histogram, width)))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")
    ranked = pieces.join(per_part.select("length", "part", before.alias("before")), ["length", "part"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches):
        rows = where.value
        keys = rows[:, 0] << 44 | rows[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            r = rows[np.searchsorted(keys, length << 44 | rank, side="right") - 1]
            q = rank - r[:, 1]
            sequence = pa.array(r[:, 2] + q // r[:, 3])
            offset = pa.array(r[:, 4] + q % r[:, 3] * length)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], sequence, offset], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, PLACED)


def op5_pattern_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), read_local(public_tokenizers.path("word_bpe_49k.json")))
