"""Spelling variants, centroid clusters and the Jaccard join, by brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import centroids, jaccard, spelling
from tests.llm import brute

DOCS = "doc_id long, text string"
VECS = "vec_id long, embedding array<float>, label int"


def key(rows):
    return sorted(rows, key=repr)


def variants_of(spark, rows, **options):
    df = spark.createDataFrame(rows, DOCS).withColumn("word", F.lit(1)).withColumn("n", F.lit("x"))
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df, **options).collect()}


def corpus(seed, n=120):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcdé") for _ in range(rng.randint(4, 9))) for _ in range(40)]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 60)):
            w = rng.choice(stems)
            if rng.random() < 0.3:
                p = rng.randrange(len(w))
                w = rng.choice([w[:p] + w[p + 1 :], w[:p] + rng.choice("abcdé") + w[p:], w[:p] + "b" + w[p + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        out.append((i, rng.choice([" ", ", ", "1", "\n"]).join(words)))
    return [*out, (500, None), (501, ""), (None, "abcdeabcde " * 9), (7, "abcdeabcd " * 5), (7, "abcdeabcd " * 5), (502, "× ÷÷÷÷÷÷ ÷÷÷÷÷÷ ÷÷÷÷÷÷"), (503, "Ÿabcde xÀÿÀÿÀÿ " * 3), (504, "z" * 600 + " " + "z" * 601)]


@pytest.mark.parametrize("shard_words", [4096, 40, 3])
def test_op11_against_brute_force(spark, shard_words):
    rows = corpus(shard_words)
    want = brute.op11(rows)
    assert any(w[0] for w in want.values()) and any(w[3] > 1 for w in want.values())
    assert variants_of(spark, rows, shard_words=shard_words) == want


def test_op11_chains_and_empty(spark):
    chain = "abcdefgh" * 2
    rows = [(9000 + i, " ".join([chain[: 6 + i]] * (3 * 2 ** i))) for i in range(7)]
    got = variants_of(spark, rows)
    assert got == brute.op11(rows) and len({r[1] for r in got.values()}) < len(got) // 2 + 1
    assert variants_of(spark, []) == {} and variants_of(spark, [(None, None)]) == {}


def test_op11_index_finds_what_agrees_in_half():
    rng = random.Random(1)
    near = lambda a, b: a == b or (len(a) == len(b) and sum(x != y for x, y in zip(a, b)) == 1) or (abs(len(a) - len(b)) == 1 and any(max(a, b, key=len)[:i] + max(a, b, key=len)[i + 1 :] == min(a, b, key=len) for i in range(max(len(a), len(b)))))
    for _ in range(40):
        words = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(3, 8))) for _ in range(80)})
        exact = [len(w) - len(w) // 2 for w in words]
        q, w = spelling.search(spelling.FMIndex(words), words, exact)
        want = {(a, b) for a, e in zip(words, exact) for b in words if b.endswith(a[-e:]) and near(a[:-e], b[:-e])}
        assert {(words[i], words[j]) for i, j in zip(q, w)} == want


def test_op11_crc_is_joined():
    import zlib

    for n in (0, 1, 7, 255, 300):
        got = spelling.joined_crc(np.array([zlib.crc32(b"12:")], dtype=np.uint32), np.array([zlib.crc32(b"a" * n)], dtype=np.uint32), np.array([n]))
        assert got[0] == zlib.crc32(b"12:" + b"a" * n)


def vectors(seed, n, dims=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 0.3, (5, dims))
    out = [(i, [float(x) for x in base[i % 5] + rng.normal(0, 0.1, dims)], i) for i in range(n)]
    odd = [(900, None, 0), (901, [0.5] * (dims - 1), 0), (902, [0.5] * (dims - 1) + [None], 0), (903, [0.5] * (dims - 1) + [float("nan")], 0), (904, [float("inf")] * dims, 0), (905, [], 0)]
    return [*out, *odd, (None, [0.25] * dims, 1), (7, [-0.25] * dims, 1), (3, out[3][1], 1) if n > 3 else (3, [1.0] * dims, 1), (906, [1.0e4] * dims, 2)]


@pytest.mark.parametrize(("n", "block"), [(300, 16), (300, 10), (9, 64), (0, 16)])
def test_op12_against_brute_force(spark, n, block):
    rows = vectors(n + block, n)
    df = spark.createDataFrame(rows, VECS).withColumn("cluster", F.lit("x")).repartition(5)
    got = [tuple(r) for r in centroids.cluster(df, block=block).collect()]
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v, _ in rows]
    assert key(got) == key(brute.op12(exact))


def test_op12_ties_and_empty(spark):
    rows = [(i, [float(i % 2)] * 64, 0) for i in range(40)]
    got = [tuple(r) for r in centroids.cluster(spark.createDataFrame(rows, VECS)).collect()]
    assert key(got) == key(brute.op12([(i, v) for i, v, _ in rows]))
    assert centroids.cluster(spark.createDataFrame([], VECS)).collect() == []
    assert centroids.cluster(spark.createDataFrame([(1, None, 0)], VECS)).collect() == []


def near_sets(seed, n=90):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(k)] for k in (5, 9, 11, 30, 60, 150, 400)]
    line = [rng.choice(words) for _ in range(12)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            p = rng.randrange(len(w))
            w[p : p + rng.choice([0, 1, 1, 2])] = [rng.choice(words)] * rng.choice([0, 1, 1])
        if rng.random() < 0.3:
            w = w + line
        if rng.random() < 0.2:
            w = [x.upper() for x in w]
        out.append(" ".join(w))
    return [*out, None, "", " \n", "one", "One", "one two three", "one two three", "a b c d", "a b c d e", "x " * 50, "x " * 9, out[0], out[0]]


@pytest.mark.parametrize("cells", [1 << 13, 300, 40])
def test_op13_against_brute_force(spark, cells):
    texts = near_sets(cells)
    rows = [(i * 7 % len(texts) if len(texts) % 7 else i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (3, texts[2]), (3, texts[2]), (None, "only a null here with words"), (None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("node", F.lit(1)).withColumn("root", F.lit("x")).repartition(6)
    got = [tuple(r) for r in jaccard.jaccard_components(df, cells).collect()]
    want = brute.op13(rows)
    assert len({w[2] for w in want}) < len(want) * 0.8
    assert key(got) == key(want)


def test_op13_empty_and_long(spark):
    assert jaccard.jaccard_components(spark.createDataFrame([], DOCS)).collect() == []
    long = " ".join(str(i * i % 7919) for i in range(30_000))
    rows = [(1, long), (2, long + " more words here"), (3, long[:100_000]), (4, None)]
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {d: c for d, _, c in brute.op13(rows)}


def test_op13_trie_finds_all_links():
    rng = np.random.default_rng(3)
    for _ in range(60):
        base = np.unique(rng.integers(0, 1 << 60, 40).astype(np.uint64))
        sets = {tuple(np.unique(np.concatenate([rng.permutation(base)[: len(base) - rng.integers(0, 6)], rng.integers(0, 1 << 60, rng.integers(0, 5)).astype(np.uint64)])).tolist()) for _ in range(25)}
        sets = [np.array(x, dtype=np.uint64) for x in sets]
        trie = jaccard.Trie(sets)
        for e, i in enumerate(trie.order):
            own = set(sets[i].tolist())
            want = [f for f in range(e + 1, len(sets)) if 100 * len(own & set(sets[trie.order[f]].tolist())) >= 85 * len(own | set(sets[trie.order[f]].tolist()))]
            assert sorted(trie.near(sets[i], e, np.zeros(len(sets), dtype=bool)).tolist()) == want


def test_op13_stretches_meet_whenever_sets_link():
    rng = np.random.default_rng(5)
    for _ in range(400):
        a = np.unique(rng.integers(0, 1 << 63, rng.integers(1, 200)).astype(np.uint64))
        b = np.unique(np.concatenate([rng.permutation(a)[: max(1, int(len(a) * rng.uniform(0.85, 1)))], rng.integers(0, 1 << 63, rng.integers(0, max(1, len(a) // 8) + 1)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        if np.array_equal(a, b) or 185 * both < 85 * (len(a) + len(b)):
            continue
        who, keys, _ = jaccard.stretch_keys(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert set(keys[who == 0].tolist()) & set(keys[who == 1].tolist())
