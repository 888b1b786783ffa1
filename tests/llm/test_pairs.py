"""Near duplicates, vectors and the pipeline against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pricewright.llm import minhash, nn_descent, pii
from pricewright.llm.common import Scratch
from pricewright.llm.graph import components
from pricewright.llm.shingles import word_hashes

from .conftest import ODD


def classes_of(links, ids):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = last + 1 if x == y else max(row[j + 1], row[j])
            last = keep
    return row[-1]


def test_alignment_by_plain_table():
    rng = np.random.default_rng(5)
    for _ in range(200):
        a = rng.integers(0, int(rng.integers(2, 60)), int(rng.integers(1, 60))).astype(np.uint64)
        b = a.tolist()
        for _ in range(int(rng.integers(0, 7))):
            at = int(rng.integers(0, len(b) + 1))
            b[at : at + int(rng.integers(0, 3))] = rng.integers(0, 60, int(rng.integers(0, 3))).tolist()
        b = np.array(b, np.uint64)
        m = longest(a.tolist(), b.tolist())
        want = m / (len(a) + len(b) - m) if len(b) else 0
        assert minhash.aligned(a, b) == pytest.approx(want if want >= 0.8 - 1e-12 else 0)


def test_long_alignment(monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(minhash, "DROP", 16)
    for kinds in (40, 5000):
        a = rng.integers(0, kinds, 700).astype(np.uint64)
        b = np.delete(np.insert(a, rng.integers(0, 700, 30), rng.integers(0, kinds, 30).astype(np.uint64)), rng.integers(0, 700, 25))
        m = longest(a.tolist(), b.tolist())
        assert minhash.aligned(a, b) == pytest.approx(m / (len(a) + len(b) - m))
    monkeypatch.undo()
    a = rng.integers(0, 10**9, 200_000).astype(np.uint64)
    b = np.delete(a, np.arange(5, 200_000, 23))
    assert minhash.aligned(a, b) == pytest.approx(len(b) / len(a))


def test_alignment_of_texts_that_repeat_themselves(monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(minhash, "DROP", 16)
    monkeypatch.setattr(minhash, "OFTEN", 3)
    for period in (1, 2, 5, 30):
        for _ in range(6):
            a = np.tile(rng.integers(0, 50, period), 600 // period).astype(np.uint64)
            b = np.delete(np.insert(a, rng.integers(0, len(a), 20), rng.integers(0, 60, 20).astype(np.uint64)), rng.integers(0, len(a), 30))[int(rng.integers(0, 9)) :]
            m = longest(a.tolist(), b.tolist())
            assert minhash.aligned(a, b) == pytest.approx(m / (len(a) + len(b) - m))
    monkeypatch.undo()
    import time

    a = np.tile(rng.integers(0, 1 << 60, 7).astype(np.uint64), 20_000)
    b = np.concatenate([a[3:], rng.integers(0, 1 << 60, 500).astype(np.uint64)])
    start = time.process_time()
    assert minhash.aligned(a, b) == pytest.approx((len(a) - 3) / (len(b) + 3), abs=1e-3) and time.process_time() - start < 20


def similarity(a, b):
    x, y = (minhash.shingle_sequence(word_hashes(pa.array([t]))[0]).tolist() for t in (a, b))
    if a == b:
        return 1.0
    if not x or not y:
        return float(not x and not y and (a or "") == (b or ""))
    m = longest(x, y)
    return m / (len(x) + len(y) - m)


def near_copies(seed=1, groups=12):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 6))) for _ in range(4000)]
    texts = []
    passage = r.choices(words, k=60)
    for g in range(groups):
        base = r.choices(words, k=r.choice([4, 9, 12, 30, 58, 64, 90, 200, 400]))
        texts.append(" ".join(base))
        for _ in range(r.randint(1, 4)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 60))):
                copy[r.randrange(len(copy))] = r.choice(words)
            texts.append((" ".join(copy).capitalize() + ".") if r.random() < 0.5 else " ".join(copy))
        texts.append(" ".join(r.choices(words, k=100) + passage))
    return texts


def test_classes_by_all_pairs(spark):
    texts = near_copies()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if similarity(texts[i], texts[j]) >= 0.8]
    assert len(links) > 10
    rows = minhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == classes_of(links, range(len(texts)))
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in rows)
    assert {r["doc_id"] for r in minhash.keep_one(docs).collect()} == set(classes_of(links, range(len(texts))).values())


def test_large_groups(spark):
    """A third of the rows exact copies, a third near copies, and the rest share a passage without being alike."""
    r = random.Random(2)
    words = ["".join(r.choices("abcdefghij", k=5)) for _ in range(5000)]
    base, passage = r.choices(words, k=150), r.choices(words, k=60)
    near = [" ".join(base[:k] + ["zzz"] + base[k + 1 :]) for k in range(150)]
    apart = [" ".join(r.choices(words, k=110) + passage) for _ in range(150)]
    texts = ["the same words again and again in this copy"] * 150 + near + apart
    got = {x["doc_id"]: x["class_id"] for x in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {got[i] for i in range(150)} == {0} and {got[i] for i in range(150, 300)} == {150} and [got[i] for i in range(300, 450)] == list(range(300, 450))


def test_documents_odd(spark, odd_docs, no_docs):
    rows = minhash.near_duplicates(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by = {r["doc_id"]: (r["class_id"], r["kept"]) for r in rows}
    assert by[0] == (0, True) and by[1] == (0, False) and by[3] == (3, True) and by[None] == (None, False)
    kept = minhash.keep_one(odd_docs)
    assert kept.schema == odd_docs.schema
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert ids == [(False, i) for i in range(len(ODD)) if i != 1] + [(True, 0)]
    nulls = spark.createDataFrame([(None, "one two three four five six seven"), (None, "one two three four five six seven"), (None, "other words")], "doc_id long, text string")
    assert sorted(r["text"] for r in minhash.keep_one(nulls).collect()) == ["one two three four five six seven", "other words"]
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.keep_one(no_docs).count() == 0


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 160)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(40)]
    want = classes_of(edges, {x for e in edges for x in e})
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in want.items() if k in linked}


def vector_rows(seed=3, clusters=10, size=30, alone=300, dim=24):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(clusters):
        c = rng.normal(size=dim)
        c /= np.linalg.norm(c)
        out += [c + rng.normal(size=dim) * rng.uniform(0.01, 0.06) for _ in range(int(rng.integers(2, size)))]
    hub = rng.normal(size=dim)
    out += [hub + rng.normal(size=dim) * 0.03 for _ in range(160)] + [hub] * 40
    out += list(rng.normal(size=(alone, dim)))
    return [x.astype(np.float32).tolist() for x in out]


def test_links_by_all_pairs(spark):
    vectors = vector_rows()
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    want = classes_of([(int(a), int(b)) for a, b in zip(*np.nonzero(hit), strict=True) if a < b], range(len(x)))
    rows = spark.createDataFrame([(i, v, i % 3) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in nn_descent.near_vectors(rows).collect()}
    assert [got[i]["n_links"] for i in range(len(x))] == hit.sum(axis=1).tolist()
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_blocks_of_a_component(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 32)
    rng = np.random.default_rng(8)
    x = rng.normal(size=8) + rng.normal(size=(150, 8)) * 0.2
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in nn_descent.near_vectors(rows).collect()}
    assert [got[i] for i in range(150)] == hit.sum(axis=1).tolist()


def test_vectors_odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0, 0.0]), (7, [2.0, 0.0]), (None, [1.0, 0.001]), (9, [3e38, 1e30]), (10, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "n", 1) for i, v in rows], "vec_id long, embedding array<double>, node string, h int")
    got = nn_descent.near_vectors(df).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in got}
    assert by[0] == (4, 0, True) and by[7] == (4, 0, False) and by[9] == (4, 0, False) and by[None] == (4, 0, False)
    assert all(by[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 8, 10))
    assert nn_descent.near_vectors(df.limit(0)).count() == 0


def test_pipeline(spark, sf, word_vocabulary):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scratch, seen = Scratch(spark, "test-pipeline"), docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = seen
        seen = scratch.write(stage(spark, before, sf), name)
        assert seen.columns == docs.columns and [f.dataType for f in seen.schema] == [f.dataType for f in docs.schema]
        a, b = ({r["doc_id"]: r["text"] for r in d.collect()} for d in (before, seen))
        assert set(b) <= set(a)
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
            assert not [i for i in set(a) - set(b) if labels.get(i) == 1]
        if name == "near_duplicates":
            ids = sorted(a)
            sets = {i: set(minhash.shingle_sequence(word_hashes(pa.array([a[i]]))[0]).tolist()) for i in ids}
            close = [(i, j) for n, i in enumerate(ids) for j in ids[n + 1 :] if a[i] == a[j] or sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])]
            links = [(i, j) for i, j in close if similarity(a[i], a[j]) >= 0.8]
            assert set(b) == set(classes_of(links, ids).values())
        if name == "pii":
            want = {r["doc_id"]: r["text"] for r in pii.pseudonymize(before, pii.DEMO_KEY).collect()}
            assert b == want and seen.where(F.length("text") != F.col("n_chars")).count() == 0
    rows = corpus_pipeline.STAGES[-1][1](spark, seen, sf).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in seen.select("doc_id").collect()}
    whole = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in whole) == sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in rows)


def test_pipeline_odd(spark, odd_docs, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, a null id, columns that stages use themselves; no labels; no rows."""
    labels = "doc_id long, quality int, toxic int"
    cases = {
        "odd": (odd_docs, spark.createDataFrame([(0, 1, 0), (3, 1, 0), (3, 1, 0), (5, 0, None), (None, 1, 0), (77, None, None)], labels)),
        "no labels": (odd_docs, spark.createDataFrame([], labels)),
        "no rows": (odd_docs.limit(0), spark.createDataFrame([(0, 1, 0)], labels)),
        "ties": (spark.createDataFrame([(i, "the same seven words are in here", "x", 32, 1.0, "y") for i in (5, 5, 4, 9, None)], odd_docs.schema), spark.createDataFrame([(4, 1, 0), (9, 0, 0)], labels)),
    }
    for name, (docs, labelled) in cases.items():
        at = str(tmp_path / name.replace(" ", "-"))
        docs.withColumn("pw_id", F.lit(1)).withColumn("n", F.lit("n")).write.parquet(f"{at}/documents.parquet")
        labelled.write.parquet(f"{at}/labels.parquet")
        seen, scratch = spark.read.parquet(f"{at}/documents.parquet"), Scratch(spark, "odd")
        for stage_name, stage in corpus_pipeline.STAGES[:-1]:
            after = scratch.write(stage(spark, seen, at), stage_name)
            assert after.schema == seen.schema and after.count() <= seen.count()
            seen = after
        rows = corpus_pipeline.run(spark, at).collect()
        left = [r["doc_id"] for r in seen.select("doc_id").collect()]
        assert sorted({(r["doc_id"] is None, r["doc_id"] or 0) for r in rows}) == sorted({(i is None, i or 0) for i in left})
        by: dict = {}
        for r in rows:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for placed in by.values():
            placed.sort()
            assert [o for o, _ in placed] == [sum(n for _, n in placed[:k]) for k in range(len(placed))]
        if name == "no labels":
            assert len(left) == len({r["text"] or "" for r in odd_docs.collect()}) and len(set(left)) == len(left)
        if name == "ties":
            assert left == [4]
        if name == "no rows":
            assert rows == []


def linked_by_all_pairs(vectors):
    x = np.array(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.95
    np.fill_diagonal(hit, False)
    return hit.sum(axis=1).tolist(), classes_of([(int(a), int(b)) for a, b in zip(*np.nonzero(hit), strict=True) if a < b], range(len(x)))


def same_as_all_pairs(spark, vectors):
    rows = nn_descent.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows.collect()}
    links, groups = linked_by_all_pairs(vectors)
    assert got == {i: (links[i], groups[i]) for i in range(len(vectors))}


def at_cosine(rng, base, cosine):
    """Vectors of the given cosine with those of ``base``."""
    off = rng.normal(size=base.shape)
    off -= (off * base).sum(axis=1)[:, None] * base
    off /= np.linalg.norm(off, axis=1)[:, None]
    return cosine * base + np.sqrt(1 - cosine**2) * off


def units(x):
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_groups_linked_across_full_lists(spark, monkeypatch):
    """Two groups of 80 whose members all link, each with its list full of its own group."""
    monkeypatch.setattr(nn_descent, "BLOCK", 4)
    rng = np.random.default_rng(11)
    one = units(rng.normal(size=(1, 64)))
    centres = np.concatenate([one, at_cosine(rng, one, 0.965)])
    same_as_all_pairs(spark, units(np.repeat(centres, 80, axis=0) + rng.normal(size=(160, 64)) * 0.008))


def test_pairs_beside_a_hot_group(spark):
    """Links of the large group outnumber those of 700 pairs close to the threshold."""
    rng = np.random.default_rng(12)
    base = units(rng.normal(size=(700, 64)))
    hot = units(rng.normal(size=(1, 64)) + rng.normal(size=(500, 64)) * 0.05)
    same_as_all_pairs(spark, np.concatenate([hot, base, at_cosine(rng, base, 0.9505)]))


def test_links_that_no_search_finds(spark, monkeypatch):
    """Without any candidate from the search, all links and components are there all the same."""
    monkeypatch.setattr(nn_descent, "FLOOR", 2.0)
    same_as_all_pairs(spark, np.array(vector_rows(clusters=4, size=12, alone=60), np.float64))


def test_crowded_pair_with_one_sketch(spark, monkeypatch):
    """Ten texts meet in one bucket and agree on nothing else; the two that are alike are a link."""
    monkeypatch.setattr(minhash, "COUNTED", 50, raising=False)
    rng = np.random.default_rng(13)
    texts = [rng.integers(1, 1 << 60, 30).astype(np.uint64) for _ in range(10)]
    texts[6] = np.concatenate([texts[2], texts[2][:2]])
    n = [len(minhash.shingle_sequence(t)) for t in texts]
    bucket = spark.createDataFrame([(7, i, n[i], 10, i) for i in range(10)], "k long, node long, n long, members long, component long")
    nodes = spark.createDataFrame([(i, [7] + [1000 + 100 * i + j for j in range(1, 24)]) for i in range(10)], "node long, keys array<long>")
    words = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in enumerate(texts)], "node long, words binary")
    got = [(r["a"], r["b"]) for r in minhash._crowded(bucket, nodes, words, 0.8).collect()]
    assert got == [(2, 6)]


def test_shingles_in_common(monkeypatch):
    rng = np.random.default_rng(14)
    texts = [np.tile(rng.integers(1, 4, int(rng.integers(0, 30))), 2).astype(np.uint64) for _ in range(12)]
    counts = [Counter(minhash.shingle_sequence(t).tolist()) for t in texts]
    left, right = [t.tobytes() for t in texts[:5]], [t.tobytes() for t in texts[5:]]
    want = [[(x & y).total() for y in counts[5:]] for x in counts[:5]]
    for counted, columns in ((minhash.COUNTED, minhash.COLUMNS), (37, 3)):
        monkeypatch.setattr(minhash, "COUNTED", counted)
        monkeypatch.setattr(minhash, "COLUMNS", columns)
        assert minhash._in_common(left, right).tolist() == want


def test_long_addresses_and_secrets(spark):
    key = "k"

    def fill(m):
        seed = hashlib.sha256(f"{key}:secret:{m.lower()}".encode()).hexdigest()
        return "".join(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() for i in range(len(m) // 64 + 1))[: len(m)]

    values = ["a1" * 20, "0f" * 64, "0f" * 150, "sk_" + "aB3" * 60, "ghp_" + "aB3" * 200, "sk-" + "x9" * 20_000]
    mails = ["x" * 65 + "@example.com", "name@" + "y" * 64 + ".org"]
    rows = spark.createDataFrame([(i, f"see {v} here") for i, v in enumerate(values + mails)], "doc_id long, text string")
    got = [r["text"] for r in pii.pseudonymize(rows, key, count="n").orderBy("doc_id").collect()]
    assert got[: len(values)] == [f"see {fill(v)} here" for v in values]
    assert all(g.endswith(".invalid here") and v not in g for g, v in zip(got[len(values) :], mails, strict=True))
