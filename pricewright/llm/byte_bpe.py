"""Byte-level BPE by DuckDB recursive queries, one in-memory database in each Python worker.

The distinct pre-tokens of a slice become rows (word, position, token). A recursive query joins neighbouring rows with
the merge table and contracts each word's leftmost pair of least rank, until no word has a pair left. An aggregate
ordered by position turns the ids of a word back into bytes. Words already known to the worker aren't sent again.

A word of many bytes is cut into pieces, which are contracted as if they were words; then their seams are mended. This
gives what contracting the whole word gives, because a sequence of tokens is the result for its bytes if every two
neighbours are the result for theirs: take the first contraction of the whole that joins something of both neighbours.
Up to it both went the way they go when contracted alone, and alone they never join; so there is no such contraction.
Where two neighbours at a seam fail this, a window around them is contracted anew, and its own edges are looked at next.
"""

from __future__ import annotations

import base64
import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .common import read_local, table
from .words import slices

#: Words that a worker keeps; past this it keeps those that came up again, at most half as many.
CACHE_WORDS = 300_000
#: Bytes of texts that are worked on at once; a longer text is worked on alone.
SLICE_BYTES = 4_000_000
#: Rows that a recursive query may go through, and contractions of a word in one query.
QUERY_ROWS, DEPTH = 3_000_000, 48
#: Ids that are decoded by one query.
DECODED = 500_000
#: Bytes of a piece. Words of at most twice as many aren't cut.
PIECE = 32
#: Tokens beside a seam that are contracted anew, one round after the other; then bytes of a window that moves along the word.
MENDED, WINDOW = (2, 4, 8, 16, 32), 1 << 14

#: Fixed values: ``\s`` of the pattern as the tokenizer's own regex library reads it.
SPACE_CLASS, NO_SPACE_CLASS = r"\p{White_Space}", r"\P{White_Space}"

TABLES = """
create table vocab(id integer, hexed varchar);
create table merges(pair bigint, id integer, alone boolean);
"""
#: One step: neighbours joined with the merges, the least (rank, place) of each word, and its two rows made one. A row's place is word << 16 | byte.
STEP = """
with recursive state(place, id, next_place, next_id, depth) as (
  select place, id, lead(place) over w, lead(id) over w, 0 from pieces window w as (order by place)
  union all
  (with least as (
     select place >> 16 as word, min((m.id::bigint << 32) | ((place & 65535) << 16) | (next_place & 65535)) as k
     from state join merges m on m.pair = ((state.id::bigint << 20) | next_id)
     where depth < $depth and place >> 16 = next_place >> 16 group by 1)
   select place, case when place & 65535 = (k >> 16) & 65535 then (k >> 32)::integer else id end as new_id, lead(place) over w, lead(new_id) over w, depth + 1
   from state join least on word = place >> 16 where place & 65535 <> k & 65535 window w as (order by place))
), last as (select place >> 16 as word, max(depth) as depth from state group by 1)
select place, id, state.depth from state join last on word = place >> 16 and last.depth = state.depth
"""
#: As STEP for windows that grew: where no token that holds the new one has a lower rank, every occurrence at an odd place of its run goes in one step, as it would one by one.
STEP_WIDE = """
with recursive state(word, pos, id, following, depth) as (
  select place >> 32, place & 4294967295, id, lead(id) over (partition by place >> 32 order by place), 0 from pieces
  union all
  (with least as (
     select word, min((m.id::bigint << 32) | pos) as k, min_by(m.alone, (m.id::bigint << 32) | pos) as alone, min_by(m.pair, (m.id::bigint << 32) | pos) as pair
     from state join merges m on m.pair = ((state.id::bigint << 20) | following) where depth < $depth group by word),
   hits as (
     select s.word, s.pos, s.id, s.depth, k, alone, ((s.id::bigint << 20) | following) is not distinct from pair as hit,
            row_number() over (partition by s.word order by s.pos) as place
     from state s join least using (word)),
   runs as (
     select *, place - max(case when hit then 0 else place end) over (partition by word order by pos) as nth from hits),
   marked as (
     select word, pos, id, depth, k, hit and case when alone then pos = (k & 4294967295) else nth % 2 = 1 end as taken from runs),
   joined as (
     select word, pos, depth, case when taken then (k >> 32)::integer else id end as id,
            coalesce(lag(taken) over (partition by word order by pos), false) as gone from marked)
   select word, pos, id, lead(id) over (partition by word order by pos), depth + 1 from joined where not gone)
), last as (select word, max(depth) as depth from state group by word)
select (word << 32) | pos as place, id, depth from state join last using (word, depth)
"""
DECODE = "select unhex(string_agg(hexed, '' order by pos)) as raw from ids join vocab using (id) group by word order by word"


def rank_table(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines()) if token}


def _halves(token: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """What is left of a token's bytes when at most two tokens are."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        at = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], 1 << 31), i))
        if parts[at] + parts[at + 1] not in ranks:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def merge_rows(ranks: dict[bytes, int]) -> tuple[list[int], list[int], list[bool]]:
    """(left << 20 | right, rank of both together, whether a token that holds it has a lower rank) of every pair that is ever contracted.

    That is one for each token: before two tokens become one, what lies under them was contracted as if it stood alone.
    """
    pairs, ids = [], []
    lowest: dict[int, int] = {}
    for token, rank in ranks.items():
        halves = _halves(token, ranks)
        if len(halves) == 2:
            left, right = (ranks[x] for x in halves)
            pairs.append(left << 20 | right)
            ids.append(rank)
            for half in (left, right):
                lowest[half] = min(lowest.get(half, rank), rank)
    return pairs, ids, [lowest.get(i, i) < i for i in ids]


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, where each value starts and the last ends) of a binary array."""
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all spans (start, size), one span after the other."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


def _join(ends: np.ndarray, values: pa.Array, between) -> pa.Array:
    """Runs of values, each run from one of ``ends`` to the next, put together."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values), pa.scalar(between, values.type))


class DuckBpe:
    def __init__(self, vocabulary: bytes, pattern: str):
        import duckdb

        self.ranks = rank_table(vocabulary)
        self.bytes_of = {i: t for t, i in self.ranks.items()}
        if missing := [b for b in range(256) if bytes([b]) not in self.ranks]:
            raise ValueError(f"the vocabulary lacks bytes {missing[:5]}")
        if max(self.ranks.values()) >= 1 << 20:
            raise ValueError("ranks of 20 bits at most")
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.size_of = np.zeros(max(self.ranks.values()) + 1, np.int64)
        self.size_of[list(self.ranks.values())] = [len(t) for t in self.ranks]
        self.tokens, self.token_ids = pa.array(list(self.ranks), pa.large_binary()), np.array(list(self.ranks.values()))
        self.split = regex.compile(pattern.replace(r"\S", NO_SPACE_CLASS).replace(r"\s", SPACE_CLASS))
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "450MB", "temp_directory": ""})
        self.con.execute(TABLES)
        pairs, ids, alone = merge_rows(self.ranks)
        self._fill("merges", pair=pa.array(pairs, pa.int64()), id=pa.array(ids, pa.int32()), alone=pa.array(alone, pa.bool_()))
        self._fill("vocab", id=pa.array(self.token_ids, pa.int32()), hexed=pa.array([t.hex() for t in self.ranks], pa.string()))
        self.known: dict[str, int] = {}
        self.seen, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.names, self.raws = pa.array([], pa.large_string()), pa.array([], pa.large_binary())

    def _fill(self, name: str, **columns) -> None:
        rows = pa.table(columns)  # noqa: F841  the query below reads it by name
        self.con.execute(f"insert into {name} select * from rows")

    def _query(self, place: np.ndarray, ids: np.ndarray, query: str, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, id) in order of place, when no pair is left."""
        done = []
        while len(place):
            self.con.register("pieces", pa.table({"place": place, "id": ids}))
            got = self.con.execute(query, {"depth": depth}).fetchnumpy()
            self.con.unregister("pieces")
            place, ids, more = got["place"], got["id"], got["depth"] >= depth
            done.append((place[~more], ids[~more]))
            order = np.argsort(place[more])
            place, ids = place[more][order], ids[more][order]
        place, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(place)
        return place[order], ids[order]

    def contract(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word number, id) of each id in order; word i is the bytes ``raw[at[i]:at[i + 1]]``, contracted from single bytes."""
        size = np.diff(at)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int32))]
        short = np.flatnonzero((size > 0) & (size <= 2 * PIECE))
        # A word of n bytes is n rows of the first step and one less of each after that.
        cost = np.cumsum(size[short] * np.minimum(size[short], DEPTH))
        first = 0
        while first < len(short):
            to = max(first + 1, int(np.searchsorted(cost, (cost[first - 1] if first else 0) + QUERY_ROWS, side="right")))
            some = short[first:to]
            owner = np.repeat(some, size[some])
            spans = _spans(at[some], size[some])
            place, ids = self._query(owner << 16 | spans - at[owner], self.of_byte[raw[spans]], STEP, DEPTH)
            found.append((place >> 16, ids))
            first = to
        for i in np.flatnonzero(size > 2 * PIECE).tolist():
            n = int(size[i])
            _, ids = self._query(np.arange(n), self.of_byte[raw[at[i] : at[i + 1]]], STEP_WIDE, max(1, min(DEPTH, QUERY_ROWS // n)))
            found.append((np.full(len(ids), i), ids))
        word, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(word, kind="stable")
        return word[order], ids[order]

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each two tokens are the result for their bytes."""
        pairs, back = np.unique(left.astype(np.int64) << 32 | right, return_inverse=True)
        if not len(pairs):
            return np.zeros(0, bool)
        texts = [self.bytes_of[p >> 32] + self.bytes_of[p & 0xFFFFFFFF] for p in pairs.tolist()]
        word, ids = self.contract(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
        starts = np.searchsorted(word, np.arange(len(texts) + 1))
        good = np.diff(starts) == 2
        first = starts[:-1][good]
        good[good] = (ids[first] == pairs[good] >> 32) & (ids[first + 1] == pairs[good] & 0xFFFFFFFF)
        return good[back]

    def contract_long(self, raw: np.ndarray) -> np.ndarray:
        """The ids of one word of any number of bytes: pieces, then their seams."""
        # A piece starts where a character does.
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        cuts = np.append(0, heads[np.flatnonzero(np.diff(heads // PIECE)) + 1])
        at = np.append(cuts, len(raw))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        which = coded.indices.to_numpy()
        word, ids = self.contract(*_flat(coded.dictionary))
        starts = np.searchsorted(word, np.arange(len(coded.dictionary) + 1))
        sizes = np.diff(starts)[which]
        ids = ids[_spans(starts[which], sizes)]
        seams = np.cumsum(sizes)[:-1]
        for reach in MENDED:
            seams = seams[~self._fit(ids[seams - 1], ids[seams])]
            if not len(seams):
                return ids
            ids, seams = self._mend(raw, ids, seams, reach)
        return self._move_along(raw, ids, seams[~self._fit(ids[seams - 1], ids[seams])])

    def _mend(self, raw: np.ndarray, ids: np.ndarray, seams: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids with windows around the seams contracted anew, and the seams at the windows' edges."""
        lo, hi = np.maximum(seams - reach, 0), np.minimum(seams + reach, len(ids))
        first = np.append(True, lo[1:] > hi[:-1])
        lo, hi = lo[first], hi[np.append(np.flatnonzero(first)[1:] - 1, len(hi) - 1)]
        starts = np.concatenate([[0], np.cumsum(self.size_of[ids])])
        size = starts[hi] - starts[lo]
        word, new = self.contract(raw[_spans(starts[lo], size)], np.concatenate([[0], np.cumsum(size)]))
        cuts = np.searchsorted(word, np.arange(len(lo) + 1))
        out, edges, have, last = [], [], 0, 0
        for k, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
            out += [ids[last:a], new[cuts[k] : cuts[k + 1]]]
            have += a - last
            edges.append(have)
            have += int(cuts[k + 1] - cuts[k])
            edges.append(have)
            last = b
        out.append(ids[last:])
        ids, edges = np.concatenate(out), np.unique(edges)
        return ids, edges[(edges > 0) & (edges < len(ids))]

    def _move_along(self, raw: np.ndarray, ids: np.ndarray, seams: np.ndarray) -> np.ndarray:
        """Mends what wide windows left, as in words of one repeated letter: a window carries what doesn't fit to its right edge, and the next one takes it on."""
        starts = np.concatenate([[0], np.cumsum(self.size_of[ids])])
        done: list[int] = []
        at = 0
        for seam in seams.tolist():
            if seam <= at:
                continue
            done += ids[at:seam].tolist()
            at, back = seam, 1
            while True:
                b = int(np.searchsorted(starts, starts[at] + WINDOW))
                b = min(b, len(ids))
                while True:
                    kept = max(0, len(done) - back)
                    a = int(starts[at]) - sum(len(self.bytes_of[i]) for i in done[kept:])
                    _, new = self.contract(raw[a : starts[b]], np.array([0, starts[b] - a]))
                    if not kept or self._fit(np.array(done[kept - 1 : kept]), new[:1])[0]:
                        break
                    back *= 2
                done[kept:] = new.tolist()
                at, back = b, 1
                if at == len(ids) or self._fit(new[-1:], ids[at : at + 1])[0]:
                    break
        return np.array(done + ids[at:].tolist(), np.int64)

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(word number, id) of each id, in order. A word that is a token itself is that token, as in the library."""
        words = words.cast(pa.large_binary())
        raw, at = _flat(words)
        whole = pc.index_in(words, value_set=self.tokens)
        token = pc.fill_null(whole, -1).to_numpy(zero_copy_only=False)
        is_token = np.flatnonzero(token >= 0)
        found = [(is_token, self.token_ids[token[is_token]])]
        size = np.diff(at)
        rest = np.flatnonzero((token < 0) & (size <= 2 * PIECE))
        word, ids = self.contract(raw[_spans(at[rest], size[rest])], np.concatenate([[0], np.cumsum(size[rest])]))
        found.append((rest[word], ids))
        for i in np.flatnonzero((token < 0) & (size > 2 * PIECE)).tolist():
            ids = self.contract_long(raw[at[i] : at[i + 1]])
            found.append((np.full(len(ids), i), ids))
        word, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(word, kind="stable")
        return word[order], ids[order]

    def decode_words(self, word: np.ndarray, ids: np.ndarray) -> pa.Array:
        """The bytes of each word's ids, in order of the words; every word has an id."""
        ends = np.append(np.flatnonzero(np.diff(word)) + 1, len(word))
        out, at = [pa.array([], pa.large_binary())], 0
        while at < len(word):
            # Words of about so many ids at once, one at least.
            to = int(ends[max(np.searchsorted(ends, at + DECODED, side="right") - 1, np.searchsorted(ends, at, side="right"))])
            self.con.register("ids", pa.table({"word": word[at:to], "pos": np.arange(to - at), "id": ids[at:to].astype(np.int32)}))
            out += self.con.sql(DECODE).to_arrow_table().column("raw").cast(pa.large_binary()).chunks
            self.con.unregister("ids")
            at = to
        return pa.concat_arrays(out)

    def learn(self, words: pa.Array) -> None:
        """Of each new word its number of ids, the ids as text, and the bytes they decode to."""
        word, ids = self.encode_words(words)
        counts = np.bincount(word, minlength=len(words))
        base = len(self.counts)
        self.known.update(zip(words.to_pylist(), range(base, base + len(words)), strict=True))
        self.counts = np.concatenate([self.counts, counts])
        self.seen = np.concatenate([self.seen, np.zeros(len(words), np.int64)])
        self.names = pa.concat_arrays([self.names, _join(np.concatenate([[0], np.cumsum(counts)]), pa.array(ids).cast(pa.large_string()), ",")])
        self.raws = pa.concat_arrays([self.raws, self.decode_words(word, ids)])

    def _forget(self) -> None:
        """Keeps the words that most slices had, at most half of what may be known."""
        kept = np.flatnonzero(self.seen > 1)
        kept = np.sort(kept[np.argsort(-self.seen[kept], kind="stable")[: CACHE_WORDS // 2]])
        place = np.full(len(self.seen), -1)
        place[kept] = np.arange(len(kept))
        self.known = {w: p for w, p in zip(self.known, place[list(self.known.values())].tolist(), strict=True) if p >= 0}
        self.counts, self.seen = self.counts[kept], self.seen[kept]
        self.names, self.raws = (x.take(pa.array(kept)) for x in (self.names, self.raws))

    def _rows_of(self, words: pa.Array) -> np.ndarray:
        """The rows of words, new ones learnt first."""
        coded = words.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if len(self.known) > CACHE_WORDS:
            self._forget()
        rows = np.fromiter(map(self.known.get, names, repeat(-1)), np.int64, len(names))
        if (new := rows < 0).any():
            base = len(self.counts)
            self.learn(coded.dictionary.filter(pa.array(new)))
            rows[new] = np.arange(base, len(self.counts))
        self.seen[rows] += 1
        return rows[coded.indices.to_numpy(zero_copy_only=False)]

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(number of ids, the ids as decimals joined by commas, the decoded bytes) of each text. Null: empty.

        A space between two characters that aren't white space always starts a pre-token, so a text falls into chunks
        there, and each distinct chunk is split by the pattern once. A text with other white space beside a space, or
        with the mark that stands in for the cut, is one chunk.
        """
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring_regex(texts, ODD_SPACE)
        parts = pc.split_pattern(pc.if_else(whole, texts, pc.replace_substring(texts, " ", CUT + " ")), CUT)
        if pc.any(whole).as_py():
            # A text that is one chunk holds no cut, unless the mark itself is in it.
            rows = parts.to_pylist()
            for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
                rows[i] = [texts[i].as_py()]
            parts = pa.array(rows, pa.list_(pa.large_string()))
        per_text = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = parts.flatten().dictionary_encode()
        chunks = coded.dictionary
        one = pc.match_substring_regex(chunks, r"^ ?\p{L}+$")
        odd = [self.split.findall(c) for c in chunks.filter(pc.invert(one)).to_pylist()]
        words = pa.concat_arrays([chunks.filter(one), pa.array([w for ws in odd for w in ws], pa.large_string())])
        at = self._rows_of(words)
        sizes = np.ones(len(chunks), np.int64)
        starts = np.zeros(len(chunks), np.int64)
        single = one.to_numpy(zero_copy_only=False)
        sizes[~single] = [len(ws) for ws in odd]
        starts[single] = np.arange(int(single.sum()))
        starts[~single] = single.sum() + np.cumsum(sizes[~single]) - sizes[~single]
        here = coded.indices.to_numpy(zero_copy_only=False)
        rows = at[_spans(starts[here], sizes[here])]
        words_upto = np.concatenate([[0], np.cumsum(sizes[here])])
        ends = words_upto[np.concatenate([[0], np.cumsum(per_text)])]
        sums = np.concatenate([[0], np.cumsum(self.counts[rows])])
        return sums[ends[1:]] - sums[ends[:-1]], _join(ends, self.names.take(pa.array(rows)), ","), _join(ends, self.raws.take(pa.array(rows)), b"")


    def encode_long(self, text: str | None) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """As ``encode_texts`` of one text, a portion at a time, so that the words known meanwhile stay few."""
        parts = [self.encode_texts(pa.array([p], pa.large_string())) for p in portions(text or "")]
        names = ",".join([x for _, names, _ in parts if (x := names[0].as_py())])
        return np.array([sum(int(n[0]) for n, _, _ in parts)]), pa.array([names], pa.large_string()), pa.array([b"".join([raws[0].as_py() for _, _, raws in parts])], pa.large_binary())


#: Stands before a space where a text is cut; and what keeps a text whole: the mark itself, or white space beside a space or at the start or end.
CUT = "\x01"
ODD_SPACE = r"\x01|^ | $| [\s\x0b\x1c-\x1f\x85\p{Z}]|[\s\x0b\x1c-\x1f\x85\p{Z}] "

#: Where a long text may be cut without a change of its pre-tokens: before a lone space between two word characters.
CUTTABLE = re.compile(r"(?<=\w) (?=\w)")


def portions(text: str, size: int = SLICE_BYTES) -> list[str]:
    """The text in portions of about so many characters, as far as it can be cut."""
    out, at = [], 0
    while len(text) - at > size and (m := CUTTABLE.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


_known: dict[int, DuckBpe] = {}


def coder(vocabulary: bytes, pattern: str) -> DuckBpe:
    """One for each vocabulary in a Python worker, kept between tasks."""
    key = hash((vocabulary, pattern))
    if key not in _known:
        _known.clear()
        _known[key] = DuckBpe(vocabulary, pattern)
    return _known[key]


def encode_documents(docs: DataFrame, vocabulary: bytes, pattern: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text; ``keep_ids`` adds ids and the decoded bytes.

    Needs ``doc_id`` and ``text`` (null: empty, so no ids); other columns are left aside. Repeated rows and null ids
    stay. A text or word may be of any length. No shuffle; a task holds a slice of texts and a bounded number of known words.
    """
    book = docs.sparkSession.sparkContext.broadcast((vocabulary, pattern))

    def run(batches):
        bpe = coder(*book.value)
        for batch in batches:
            for s in slices(batch, "text", SLICE_BYTES):
                n, names, raws = bpe.encode_texts(s.column("text")) if s.num_rows > 1 or s.nbytes <= 2 * SLICE_BYTES else bpe.encode_long(s.column("text")[0].as_py())
                cols = {
                    "doc_id": s.column("doc_id").cast(pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()),
                    "ids_sha256": pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in names], pa.string()),
                    "decoded_sha256": pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in raws], pa.string()),
                }
                if keep_ids:
                    cols["ids"] = pa.array([[int(i) for i in x.split(",")] if x else [] for x in names.to_pylist()], pa.list_(pa.int32()))
                    cols["decoded"] = raws
                yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), read_local(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
