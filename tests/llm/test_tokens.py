"""Token files, packing, media and byte-level BPE against the libraries and brute force."""

import base64
import hashlib
import io
import wave
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pricewright.llm import byte_bpe, media, packing, token_files, words

from .conftest import ODD


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library(library, word_vocabulary, documents):
    texts = ODD + [r["text"] for r in documents.select("text").collect()]
    ids, n = words.ChunkEncoder(word_vocabulary).encode(pa.array(texts, pa.string()))
    at = np.concatenate([[0], np.cumsum(n)])
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == ids_of(library, t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=5))
def test_encoder_on_any_text(texts):
    with open(public_tokenizers.path("word_bpe_49k.json"), "rb") as f:
        enc = words.encoder(f.read())
    ids, n = enc.encode(pa.array(texts, pa.string()))
    assert ids.tolist() == [x for t in texts for x in enc.tokenizer.encode(t, add_special_tokens=False).ids]
    assert int(n.sum()) == len(ids)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700), st.integers(0, 700), st.integers(0, 700))
def test_pack_round_trip(values, a, b):
    x = np.array(values, np.uint32)
    p = token_files.Packed(token_files.pack(x))
    assert (p[:] == x).all() and p[a:b].tolist() == x[a:b].tolist()


def test_outliers_go_to_the_exception_list():
    x = np.arange(256, dtype=np.uint32) % 7
    x[5], x[200] = 49_000, 4_000_000_000
    p = token_files.Packed(token_files.pack(x))
    assert p.exceptions.tolist() == [1, 1] and set(p.width.tolist()) == {3} and (p[:] == x).all()


def test_token_files(spark, library, word_vocabulary, documents):
    want, start = {}, 0
    rows = sorted((r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect())
    for i, t in rows:
        ids = np.array([*ids_of(library, t), 2], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()), ids.tolist())
        start += len(ids)
    got = token_files.token_table(documents, word_vocabulary).collect()
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"], r["ids"]) for r in got} == want


def test_token_files_cut_in_parts(spark, library, word_vocabulary, monkeypatch):
    """An id that half of the rows have, and rows that are all alike, are cut; order and starts hold over all parts."""
    monkeypatch.setattr(token_files, "SAMPLE", 60)
    monkeypatch.setattr(token_files, "SEGMENT_TOKENS", 200)
    rows = [(5, f"text number {i % 40}") for i in range(150)] + [(7, "all alike")] * 150 + [(i, f"other {i}") for i in range(-50, 50)] + [(None, "none")] * 9
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(token_files, "PART_BYTES", 300)
    assert len(token_files._cuts(docs, 4)) > 8
    got = token_files.token_table(docs, word_vocabulary).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:], strict=False)) and got[0]["start"] == 0
    want = sorted((i is not None, i or 0, [*ids_of(library, t), 2]) for i, t in rows)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"]) for r in got) == want


def test_token_files_odd(odd_docs, no_docs, word_vocabulary, library):
    got = token_files.token_table(odd_docs, word_vocabulary).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None, 0, 1, 2, 3, 3, 3, *range(4, len(ODD))]
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:], strict=False))
    assert token_files.token_table(no_docs, word_vocabulary).count() == 0


def check_packing(rows, texts, library, width=packing.WIDTH):
    docs = {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
    for i, t in texts.items():
        ids, at = np.array([*ids_of(library, t), 1], "<u4"), 0
        for r in sorted(docs[i], key=lambda r: r["piece"]):
            assert r["start"] == at and r["length"] == min(width, len(ids) - at) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= width
    return len(by), sum(r["length"] for r in rows)


def test_packing(library, word_vocabulary, documents):
    rows = packing.pack_documents(documents, word_vocabulary).collect()
    used, tokens = check_packing(rows, {r["doc_id"]: r["text"] for r in documents.collect()}, library)
    assert used <= -(-tokens // packing.WIDTH) + 1


def test_packing_odd(odd_docs, no_docs, word_vocabulary, library):
    rows = packing.pack_documents(odd_docs, word_vocabulary, width=64).collect()
    once = [r for r in rows if r["doc_id"] not in (3, None)]
    assert {r["doc_id"] for r in once} == {0, 1, 2, *range(4, len(ODD))}
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all([o for o, _ in sorted(p)] == np.cumsum([0, *(n for _, n in sorted(p))])[:-1].tolist() for p in by.values())
    assert packing.pack_documents(no_docs, word_vocabulary).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1, max_size=20))
def test_plan_uses_each_length_exactly(counts):
    left = dict(counts)
    total = 0
    for pattern, n in packing.plan(counts, 64):
        assert sum(pattern) <= 64 and n > 0
        total += n
        for k in pattern:
            left[k] -= n
    assert not any(left.values())
    spaces = []
    for k in sorted((k for k, v in counts.items() for _ in range(v)), reverse=True):
        at = min((i for i, s in enumerate(spaces) if s >= k), key=lambda i: spaces[i], default=None)
        if at is None:
            spaces.append(64 - k)
        else:
            spaces[at] -= k
    assert total <= 1.12 * len(spaces) + 1


def test_media(documents):
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for r in media.media_table(documents, keep_media=True).collect():
        raw = texts[r["doc_id"]].encode()
        payload = raw + b"\xff" * (-len(raw) % 576)
        with wave.open(io.BytesIO(r["media"])) as w:
            assert w.readframes(w.getnframes()) == payload
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(r["media"]))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert r["fingerprint"] == sorted(r["fingerprint"])


def test_fingerprint_by_plain_transform():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, 576 * 9).astype(np.uint8)
    k, t = np.arange(289)[:, None], np.arange(576)
    basis = np.exp(-2j * np.pi * k * t / 576)
    peaks = []
    for n, a in enumerate(range(0, len(x) - 575, 288)):
        s = np.abs(basis @ ((x[a : a + 576].astype(float) - 128) * np.hanning(576)))
        tops = [lo + int(s[lo:hi].argmax()) for lo, hi in zip(media.BANDS, media.BANDS[1:], strict=False)]
        peaks += [(n, f) for f in tops if s[f] >= s[tops].mean()]
    want = sorted(t1 << 32 | f1 << 20 | f2 << 8 | t2 - t1 for i, (t1, f1) in enumerate(peaks) for t2, f2 in peaks[i + 1 : i + 4] if t2 - t1 <= media.REACH)
    assert media.fingerprints(x.tobytes()).tolist() == want


def test_media_odd(odd_docs, no_docs):
    rows = media.media_table(odd_docs).collect()
    assert len(rows) == odd_docs.count() and media.media_table(no_docs).count() == 0
    by = {}
    for r in rows:
        by.setdefault(r["payload_sha256"], set()).add((r["feature"], r["media_sha256"], tuple(r["fingerprint"])))
    assert all(len(v) == 1 for v in by.values())
    assert {r["payload_bytes"] for r in rows if r["n_bytes"] == 0} == {576}


@pytest.fixture(scope="module")
def bpe():
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    return raw, byte_bpe.DuckBpe(raw, public_tokenizers.PATTERN), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


HARD = ["aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 5, "ab" * 300 + "!!" * 200, "é x \x1c y", "a\x01 b c", "q  b", "x\r\ny  z ", "the" * 100, "  \n lead"]


def test_byte_bpe_equals_library(bpe, documents):
    _, own, library = bpe
    texts = ODD + HARD + [r["text"] for r in documents.select("text").collect()]
    n, names, raws = own.encode_texts(pa.array(texts, pa.string()))
    for t, k, ids, raw in zip(texts, n, names.to_pylist(), raws.to_pylist(), strict=True):
        want = library.encode_ordinary(t or "")
        assert ids == ",".join(map(str, want)) and k == len(want) and raw == (t or "").encode()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=4))
def test_byte_bpe_on_any_text(bpe_module, texts):
    _, own, library = bpe_module
    _, names, raws = own.encode_texts(pa.array(texts, pa.string()))
    assert names.to_pylist() == [",".join(map(str, library.encode_ordinary(t))) for t in texts]
    assert raws.to_pylist() == [t.encode() for t in texts]


@pytest.fixture(scope="module")
def bpe_module(bpe):
    return bpe


def test_byte_bpe_table(bpe, odd_docs, no_docs):
    raw, _, library = bpe
    rows = byte_bpe.encode_documents(odd_docs, raw, public_tokenizers.PATTERN, keep_ids=True).collect()
    texts = {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        want = library.encode_ordinary(texts[r["doc_id"]] or "")
        assert r["ids"] == want and r["n_tokens"] == len(want) and bytes(r["decoded"]) == (texts[r["doc_id"]] or "").encode()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
    assert byte_bpe.encode_documents(no_docs, raw, public_tokenizers.PATTERN).count() == 0


def _long_words():
    import random

    r = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    yield "equal letters", "a" * 1_000_000
    yield "random letters", "".join(r.choices(letters, k=1_000_000))
    yield "random ideographs", "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(1_000_000))
    yield "equal letters after a space", "x " + "b" * 200_003
    yield "a period of letters", "abcab" * 60_000
    yield "words without spaces", "theninganother" * 20_000
    yield "digits", "0123456789" * 30_000
    yield "marks", "=-" * 50_000
    yield "spaces", " " * 100_003 + "x"
    yield "one ideograph", "中" * 100_001
    for n in (63, 64, 65, 127, 129, 1000):
        yield f"{n} letters", "".join(r.choices("etaoin", k=n))


def test_byte_bpe_long_words(bpe):
    """Words of any number of bytes give the library's ids, in time that grows with them."""
    import time

    _, own, library = bpe
    for name, text in _long_words():
        start = time.process_time()
        n, names, raws = own.encode_texts(pa.array([text]))
        assert time.process_time() - start < 40, name
        assert names[0].as_py() == ",".join(map(str, library.encode_ordinary(text))) and raws[0].as_py() == text.encode(), name


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab cdeé中", min_size=1, max_size=9), min_size=1, max_size=3), st.integers(1, 400))
def test_byte_bpe_seams(bpe_module, parts, times):
    _, own, library = bpe_module
    text = "".join(parts) * times
    assert own.encode_texts(pa.array([text]))[1][0].as_py() == ",".join(map(str, library.encode_ordinary(text)))


def test_byte_bpe_text_of_many_words(bpe, monkeypatch):
    """A text of 300,000 distinct words, decoded in many queries."""
    _, own, library = bpe
    text = " ".join(f"w{i * 7919 % 1_000_003:x}" for i in range(300_000)) + " " + "k" * 2000
    monkeypatch.setattr(byte_bpe, "DECODED", 50_000)
    n, names, raws = own.encode_texts(pa.array([text, None, "a b"]))
    assert names[0].as_py() == ",".join(map(str, library.encode_ordinary(text))) and raws.to_pylist() == [text.encode(), b"", b"a b"] and n[1] == 0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab  \t\n'é_1.中\u00a0\u0301", max_size=80), st.integers(1, 20))
def test_byte_bpe_portions(bpe_module, text, size):
    """Portions of a text have the pre-tokens, and so the ids, of the whole."""
    _, own, library = bpe_module
    parts = byte_bpe.portions(text, size)
    assert "".join(parts) == text and [i for p in parts for i in library.encode_ordinary(p)] == library.encode_ordinary(text)


def test_byte_bpe_long_text(bpe, monkeypatch):
    _, own, library = bpe
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 1000)
    monkeypatch.setattr(byte_bpe.portions, "__defaults__", (5000,))
    text = " ".join(f"w{i * 7919 % 1_000_003:x} é {i}" for i in range(20_000)) + "  \n " + "x" * 9000
    n, names, raws = own.encode_long(text)
    want = library.encode_ordinary(text)
    assert names.to_pylist() == [",".join(map(str, want))] and raws.to_pylist() == [text.encode()] and n.tolist() == [len(want)]
    assert own.encode_long(None)[0].tolist() == [0] and len(own.known) < 6000


def test_byte_bpe_forgets(bpe, monkeypatch):
    """Words that came up again stay known when there are too many; ids don't depend on it."""
    _, own, library = bpe
    monkeypatch.setattr(byte_bpe, "CACHE_WORDS", 300)
    for k in range(12):
        texts = [f"common{i % 40}q once{k}x{i}z" for i in range(150)]
        _, names, _ = own.encode_texts(pa.array(texts))
        assert names.to_pylist() == [",".join(map(str, library.encode_ordinary(t))) for t in texts]
    assert len(own.known) <= 300 + 400 and len(own.known) == len(own.counts) == len(own.names) == len(own.raws)


def test_byte_bpe_ranks_of_another_order():
    """Ranks that aren't in order of training: a token may rank below one that it holds."""
    import random

    r = random.Random(3)
    for _ in range(30):
        tokens = {bytes([b]) for b in range(256)} | {"".join(r.choices("abc", k=r.randint(2, 5))).encode() for _ in range(25)}
        order = sorted(tokens)
        r.shuffle(order)
        vocabulary = b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(order))
        own = byte_bpe.DuckBpe(vocabulary, public_tokenizers.PATTERN)
        library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(order)}, special_tokens={})
        for n in (3, 20, 60, 200, 700):
            text = "".join(r.choices("abc", k=n))
            assert own.encode_texts(pa.array([text]))[1][0].as_py() == ",".join(map(str, library.encode_ordinary(text)))
