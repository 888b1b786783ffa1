"""Exact, cached encoding with a tokenizers file whose pre-tokens never span white space.

A text's ids are the ids of its space-separated chunks put together, so each distinct chunk is encoded once: a batch is
split and dictionary-encoded by Arrow, new chunks go to the library, and one gather lays the ids out. Chunks that are
Latin letters with trailing marks become two pieces, and the letters go straight to the library's BPE model; all
other chunks go through its whole pipeline.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct pieces that a worker keeps; past this it starts over, so its memory stays bounded.
CACHE_PIECES = 250_000
#: Characters of text that are split at once.
SLICE_CHARS = 2_000_000
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?#$%&*|"


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


BYTE_CHARS = _byte_chars()


class ChunkEncoder:
    """ids of whole texts; equal to ``Tokenizer.encode(text, add_special_tokens=False)``."""

    def __init__(self, vocabulary: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(vocabulary)
        self.model = self.tokenizer.model
        self.clear()

    def clear(self) -> None:
        """Piece 0 is empty. Cores are lower-case letters; wholes are marks and chunks of any other kind."""
        self.cores: dict[str, int] = {}
        self.wholes: dict[str, int] = {"": 0}
        self.flat, self.lengths, self.starts = np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _core(self, core: str) -> list[int]:
        word = core if core.isascii() else core.encode().decode("latin-1").translate(BYTE_CHARS)
        return [t.id for t in self.model.tokenize(word)]

    def _whole(self, chunks: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _pieces(self, chunks: pa.Array, known: dict[str, int], encode) -> np.ndarray:
        """The piece of each chunk; new ones are encoded and added."""
        coded = chunks.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if new := [c for c in names if c not in known]:
            ids, base = encode(new), len(self.lengths)
            known.update(zip(new, range(base, base + len(new)), strict=True))
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.starts = np.cumsum(self.lengths) - self.lengths
        of_name = np.fromiter(map(known.__getitem__, names), np.int64, len(names))
        return of_name[coded.indices.to_numpy(zero_copy_only=False)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each text). Null: empty."""
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if len(self.lengths) > CACHE_PIECES:
            self.clear()
        words = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " "), " ")
        per_text = pc.list_value_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        chunks = coded.dictionary
        simple = pc.match_substring_regex(chunks, f"^[{LETTERS}]+[{MARKS}]*$").to_numpy(zero_copy_only=False)
        pieces = np.zeros((len(chunks), 2), np.int64)
        plain = chunks.filter(pa.array(simple))
        core = pc.utf8_rtrim(plain, characters=MARKS)
        pieces[simple, 0] = self._pieces(pc.utf8_lower(core), self.cores, lambda new: [self._core(c) for c in new])
        marked = simple.copy()
        has = pc.not_equal(pc.binary_length(plain), pc.binary_length(core))
        marked[simple] = has.to_numpy(zero_copy_only=False)
        pieces[marked, 1] = self._pieces(pc.replace_substring_regex(plain.filter(has), f"^[{LETTERS}]+", ""), self.wholes, self._whole)
        pieces[~simple, 0] = self._pieces(chunks.filter(pa.array(~simple)), self.wholes, self._whole)
        at = pieces[coded.indices.to_numpy(zero_copy_only=False)].ravel()
        n = self.lengths[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.flat[np.arange(total) + np.repeat(self.starts[at] - (ends - n), n)]
        sums = np.concatenate([[0], ends])
        upto = 2 * np.cumsum(per_text)
        return ids, sums[upto] - sums[upto - 2 * per_text]


_encoders: dict[int, ChunkEncoder] = {}


def encoder(vocabulary: bytes) -> ChunkEncoder:
    """One for each vocabulary in a Python worker, kept between tasks."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = ChunkEncoder(vocabulary)
    return _encoders[key]


def forget_encoder() -> None:
    """Gives a worker's encoder back, for work that needs its memory for something else."""
    _encoders.clear()


def slices(batch: pa.RecordBatch, column: str, chars: int = SLICE_CHARS):
    """The batch in runs of rows of about so many characters; a longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    ends = np.cumsum(sizes)
    while at < len(sizes):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + chars, side="right")))
        yield batch.slice(at, to - at)
        at = to
