"""Token-id files of patched frame-of-reference blocks.

A table of segments, each a self-contained byte string of whole documents in ascending order. A segment holds blocks
of 128 ids: each block subtracts its minimum and packs the rest at the width that fits 90 % of it; what is wider keeps
its low bits there and has its position and high bits in the block's exception list. Block starts are indexed, so any
range of ids can be read without the others. Segments are rows of a Parquet table (binary column), which Spark's
committer writes whole or not at all, wherever the shared store is; ``open_segment`` reads one from its bytes alone.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read_local, table
from .words import encoder, forget_encoder, slices

MAGIC = b"PFOR1\0\0\0"
BLOCK = 128
#: The share of a block that its width fits; the rest are exceptions.
PERCENTILE = 0.9
#: A segment ends with the document that fills it.
SEGMENT_TOKENS = 1 << 19
#: Segments whose starts are broadcast, at 24 bytes each.
BROADCAST_ROWS = 200_000
#: Bytes of text whose ids make one part, and rows of the sample that cuts the parts.
PART_BYTES, SAMPLE = 1 << 27, 50_000
END_ID = 2
SEGMENT_SCHEMA = "part int, seq int, n_docs long, n_tokens long, payload binary"


def pack(values: np.ndarray) -> bytes:
    """ids (unsigned 32 bit) as patched frame-of-reference blocks."""
    n = len(values)
    nb = -(-n // BLOCK)
    v = np.zeros(nb * BLOCK, np.uint32)
    v[:n] = values
    if nb:
        v[n:] = v[(nb - 1) * BLOCK]
    v = v.reshape(nb, BLOCK)
    low = v.min(axis=1) if nb else np.zeros(0, np.uint32)
    d = v - low[:, None]
    at = int(np.ceil(PERCENTILE * BLOCK)) - 1
    fits = np.partition(d, at, axis=1)[:, at] if nb else low
    width = np.ceil(np.log2(fits.astype(np.float64) + 1)).astype(np.int64)
    wide = (d.astype(np.uint64) >> width[:, None].astype(np.uint64)).astype(np.uint32)
    row, pos = np.nonzero(wide)
    starts = np.concatenate([[0], np.cumsum(width * (BLOCK // 8))]).astype("<u8")
    packed = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width):
        if w:
            which = np.flatnonzero(width == w)
            for part in np.array_split(which, -(-len(which) // 4096)):
                bits = (d[part][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
                rows = np.packbits(bits.reshape(len(part), -1).astype(np.uint8), axis=1, bitorder="little")
                packed[starts[part].astype(np.int64)[:, None] + np.arange(rows.shape[1])] = rows
    exceptions = np.bincount(row, minlength=nb).astype(np.uint8)
    head = np.array([n, nb, len(row), len(packed)], "<u8").tobytes()
    return b"".join([head, low.astype("<u4").tobytes(), width.astype(np.uint8).tobytes(), exceptions.tobytes(), starts.tobytes(), packed.tobytes(), pos.astype(np.uint8).tobytes(), wide[row, pos].astype("<u4").tobytes()])


class Packed:
    """Reads ``pack``'s bytes; ``self[a:b]`` unpacks only the blocks of that range."""

    def __init__(self, data: bytes, at: int = 0):
        self.n, nb, ne, size = (int(x) for x in np.frombuffer(data, "<u8", 4, at))
        at += 32
        parts = []
        for kind, count in (("<u4", nb), ("u1", nb), ("u1", nb), ("<u8", nb + 1), ("u1", size), ("u1", ne), ("<u4", ne)):
            x = np.frombuffer(data, kind, count, at)
            parts.append(x)
            at += x.nbytes
        self.low, self.width, self.exceptions, self.starts, self.packed, self.pos, self.high = parts
        self.first = np.concatenate([[0], np.cumsum(self.exceptions, dtype=np.int64)])
        self.end = at

    def __getitem__(self, ids: slice) -> np.ndarray:
        a, b, _ = ids.indices(self.n)
        if b <= a:
            return np.zeros(0, np.uint32)
        i, j = a // BLOCK, -(-b // BLOCK)
        out = np.zeros((j - i, BLOCK), np.uint32)
        width = self.width[i:j].astype(np.int64)
        for w in np.unique(width):
            if w:
                which = np.flatnonzero(width == w)
                for part in np.array_split(which, -(-len(which) // 4096)):
                    rows = self.packed[self.starts[i + part].astype(np.int64)[:, None] + np.arange(int(w) * BLOCK // 8)]
                    bits = np.unpackbits(rows, axis=1, bitorder="little").reshape(len(part), BLOCK, int(w))
                    out[part] = bits.astype(np.uint32) @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
        e = slice(int(self.first[i]), int(self.first[j]))
        row = np.repeat(np.arange(j - i), self.exceptions[i:j])
        out[row, self.pos[e]] |= (self.high[e].astype(np.uint64) << width[row].astype(np.uint64)).astype(np.uint32)
        return (out + self.low[i:j, None]).ravel()[a - i * BLOCK : b - i * BLOCK]


def make_segment(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    keys = np.array([x if x is not None else 0 for x in doc_ids], "<i8")
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    return b"".join([MAGIC, np.array([len(keys)], "<u8").tobytes(), keys.tobytes(), nulls.tobytes(), lengths.astype("<u8").tobytes(), pack(ids)])


def open_segment(data: bytes) -> tuple[list[int | None], np.ndarray, Packed]:
    """(document ids, number of tokens of each, the ids)."""
    if data[:8] != MAGIC:
        raise ValueError("not a token segment")
    n = int(np.frombuffer(data, "<u8", 1, 8)[0])
    keys, nulls = np.frombuffer(data, "<i8", n, 16), np.frombuffer(data, "u1", n, 16 + 8 * n)
    lengths = np.frombuffer(data, "<u8", n, 16 + 9 * n).astype(np.int64)
    return [None if z else int(k) for k, z in zip(keys, nulls, strict=True)], lengths, Packed(data, 16 + 17 * n)


def _cuts(docs: DataFrame, least: int) -> list[tuple]:
    """Where the order of the rows is cut into parts of about equal size, as keys (has an id, id, hash of the text, row).

    From a sample of at most about SAMPLE rows, which also tells how much text there is and so how many parts it takes.
    The last two members of a key cut ids that many rows have, and rows that are all alike.
    """
    rows = docs.count()
    share = min(1.0, SAMPLE / rows) if rows else 1.0
    some = docs.sample(share, seed=5) if share < 1 else docs
    found = some.select("doc_id", F.xxhash64("text"), F.monotonically_increasing_id(), F.coalesce(F.octet_length("text"), F.lit(0))).collect()
    keys = sorted(((r[0] is not None, r[0] or 0, r[1], r[2]), r[3] + 1) for r in found)
    ends = np.cumsum([size for _, size in keys])
    parts = max(least, int(ends[-1] / share) // PART_BYTES + 1) if len(ends) else 1
    return sorted({keys[i][0] for i in np.searchsorted(ends, ends[-1] * np.arange(1, parts) / parts).tolist()}) if len(ends) else []


def _slots(spark, n: int) -> list[int]:
    """For each of n partitions a number that Spark's hash partitioning sends there, so that every part has one of its own."""
    found = spark.range(20 * n + 1000).select("id", F.pmod(F.hash("id"), F.lit(n)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()
    by = {r["p"]: r["id"] for r in found}
    return [by.get(i, i) for i in range(n)]


def encode_rows(docs: DataFrame, vocabulary: bytes, cuts: list[tuple], slots: list[int], end_id: int = END_ID) -> DataFrame:
    """slot, part, doc_id, tie, row, n and ids of each row: its ids and ``end_id`` as little-endian numbers of 16 bits, or of 32 where one needs them."""
    book = docs.sparkSession.sparkContext.broadcast((vocabulary, cuts, slots))

    def run(batches):
        words, cuts, slots = book.value
        enc = encoder(words)
        for batch in batches:
            pa.default_memory_pool().release_unused()
            for s in slices(batch, "text", 2_000_000):
                flat, size = enc.encode(s.column("text"))
                flat, size = np.insert(flat, np.cumsum(size), np.uint32(end_id)), size + 1
                kind = np.dtype("<u2" if not len(flat) or int(flat.max()) < 1 << 16 else "<u4")
                at = np.concatenate([[0], np.cumsum(size)]) * kind.itemsize
                raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(flat.astype(kind).tobytes())]).cast(pa.binary())
                doc = s.column("doc_id").cast(pa.int64())
                part = [bisect_right(cuts, (d is not None, d or 0, t, r)) for d, t, r in zip(doc.to_pylist(), s.column("tie").to_pylist(), s.column("row").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([slots[p] for p in part], pa.int64()), pa.array(part, pa.int32()), doc, s.column("tie"), s.column("row"), pa.array(size), raw], names=["slot", "part", "doc_id", "tie", "row", "n", "ids"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"), "text")
    return rows.mapInArrow(run, "slot long, part int, doc_id long, tie long, row long, n long, ids binary")


def write_tokens(docs: DataFrame, vocabulary: bytes, path: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encodes every whole text (null: empty), appends ``end_id`` and writes the segments in ascending (doc_id, text) order.

    Needs ``doc_id`` and ``text``; other columns are left aside. Null ids come first, repeated rows stay and lie side by
    side, an empty table writes no segment. Texts are encoded where they lie, each once, and ids go through one shuffle,
    in as many parts as there is text for; parts lie in order. A task holds one segment at a time.
    """
    least = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = _cuts(docs.select("doc_id", "text"), least)
    order = ["part", "doc_id", "tie", "row"]
    n = max(least, len(cuts) + 1)
    rows = encode_rows(docs, vocabulary, cuts, _slots(docs.sparkSession, n), end_id).repartition(n, "slot").sortWithinPartitions(*order).select("part", "doc_id", "n", "ids")
    budget = SEGMENT_TOKENS

    def run(batches):
        forget_encoder()
        keys, lengths, ids = [], [], []
        part, seq, held = None, 0, 0

        def flush():
            nonlocal seq, keys, lengths, ids, held
            k, le, x = keys, np.array(lengths, np.int64), np.concatenate(ids).astype(np.uint32)
            row = {"part": [part], "seq": [seq], "n_docs": [len(k)], "n_tokens": [len(x)], "payload": [make_segment(k, le, x)]}
            seq, keys, lengths, ids, held = seq + 1, [], [], [], 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("payload", pa.binary())]))

        for batch in batches:
            for now, key, n, raw in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
                if now != part:
                    if keys:
                        yield flush()
                    part, seq = now, 0
                data = raw.as_buffer()
                keys.append(key)
                lengths.append(n)
                ids.append(np.frombuffer(data, "<u2" if data.size == 2 * n else "<u4"))
                held += n
                if held >= budget:
                    yield flush()
        if keys:
            yield flush()

    rows.mapInArrow(run, SEGMENT_SCHEMA).write.mode("overwrite").parquet(path)


def read_tokens(spark, path: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and (``keep_ids``) ids of every document, read from the segments of ``path``.

    ``start`` counts all ids before the document in file order.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    sizes = segments.select("part", "seq", "n_tokens")
    # At most one row a part goes through the window without a key; parts are of 128 MB of text.
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("seq")
    starts = sizes.withColumn("s", F.sum("n_tokens").over(inside) - F.col("n_tokens")).join(parts, "part").select("part", "seq", (F.col("s") + F.col("part_start")).alias("first"))
    # Starts of few segments go to the segments; those of more are joined by a shuffle.
    starts = F.broadcast(starts) if sizes.count() <= BROADCAST_ROWS else starts
    rows = segments.join(starts, ["part", "seq"]).select("first", "payload")
    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches):
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, lengths, packed = open_segment(payload.as_buffer().to_pybytes())
                ends = np.cumsum(lengths)
                for a in range(0, len(keys), 256):
                    lo, hi = int(ends[a] - lengths[a]), int(ends[min(a + 256, len(keys)) - 1])
                    ids = packed[lo:hi]
                    cuts = np.concatenate([[lo], ends[a : a + 256]]) - lo
                    raw = ids.astype("<u4").tobytes()
                    crcs = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                    columns = [pa.array(keys[a : a + 256], pa.int64()), pa.array(first + lo + cuts[:-1]), pa.array(lengths[a : a + 256]), pa.array(crcs, pa.int64())]
                    if keep_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int64))))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids)


def token_table(docs: DataFrame, vocabulary: bytes, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """Writes the documents' ids to a new place in the shared folder and reads them back."""
    at = Scratch(docs.sparkSession, "tokens").path("segments")
    write_tokens(docs, vocabulary, at, end_id)
    return read_tokens(docs.sparkSession, at, keep_ids)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_table(table(spark, sf_dir, "documents"), read_local(public_tokenizers.path("word_bpe_49k.json")), keep_ids=False)
