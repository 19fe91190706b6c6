import math
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from hindsight.llm import nearest

SCHEMA = "vec_id long, embedding array<float>, label int, key int, block int"


def search(spark, rows, every=20, k=20):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3)
    out = nearest.nearest(df, F.col("vec_id") % every == 0, k).collect()
    assert len({(r.query_id, r["rank"]) for r in out}) == len(out)
    return {q: sorted((r["rank"], r.vec_id, r.score) for r in out if r.query_id == q) for q in {r.query_id for r in out}}


def brute_force(rows, every=20, k=20):
    ids = np.array([i for i, _ in rows])
    vectors = np.array([np.array(v, np.float32) for _, v in rows], np.float64)
    out = {}
    for i, v in zip(ids, vectors, strict=True):
        if i % every == 0:
            scores = (vectors * v).sum(axis=1)
            best = [j for j in np.lexsort((ids, -scores)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(scores[j])) for j in best]
    return out


def recall(got, true):
    hits = sum(len({v for _, v, _ in got.get(q, [])} & {v for v, _ in best}) for q, best in true.items())
    return hits / sum(len(best) for best in true.values())


@pytest.mark.parametrize("kind", ["clusters", "noise", "lengths"])
def test_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 100)
    random = np.random.default_rng(5)
    if kind == "clusters":
        vectors = random.normal(size=(100, 16))[random.integers(0, 100, 3000)] + 0.15 * random.normal(size=(3000, 16))
    else:
        vectors = random.normal(size=(3000, 16))
    if kind != "lengths":
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors)]
    got, true = search(spark, rows), brute_force(rows)
    assert recall(got, true) >= 0.9
    for q, best in got.items():
        assert [r for r, _, _ in best] == list(range(1, 21))
        keys = [(-s, v) for _, v, s in best]
        assert keys == sorted(keys)
        for _, v, s in best[:3]:
            assert s == pytest.approx(float(np.dot(np.float64(np.float32(vectors[q])), np.float64(np.float32(vectors[v])))), abs=1e-12)


def test_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 10)
    rows = [(i, [1.0, 0.0]) for i in range(200)] + [(i, [0.0, 2.0]) for i in range(200, 240)] + [(300, [3.0, 0.1])]
    got, true = search(spark, rows), brute_force(rows)
    assert {q: [(v, s) for _, v, s in best] for q, best in got.items()} == true


def test_odd_vectors(spark):
    rows = [
        (0, [1.0, 2.0]), (1, None), (2, []), (3, [0.0, 0.0]), (4, [math.nan, 1.0]), (5, [math.inf, 1.0]), (6, [None, 1.0]),
        (7, [1.0, 2.0, 3.0]), (8, [1.0, -1.0]), (8, [1.0, -1.0]), (9, [5.0, 5.0]), (None, [1.0, 1.0]), (20, [0.0, 0.0]), (40, [1.0, 2.0]), (40, [0.5, 2.0]),
    ]
    got = search(spark, rows)
    assert [(v, s) for _, v, s in got[0]] == [(9, 15.0), (40, 4.5), (8, -1.0)]
    assert [(v, s) for _, v, s in got[40]] == [(9, 12.5), (0, 4.5), (8, -1.5)]
    assert set(got) == {0, 40}


def test_nothing_to_search(spark):
    assert search(spark, []) == {}
    assert search(spark, [(1, [1.0]), (2, [1.0])]) == {}
    assert search(spark, [(20, [1.0])]) == {}


def test_hilbert_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (6, 1)):
        points = np.array(list(product(range(1 << bits), repeat=dims)))
        keys = nearest.hilbert(points, bits)
        assert sorted(keys) == list(range(len(points)))
        steps = np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1)
        assert (steps == 1).all()


def test_ties_of_unlike_vectors():
    """200 distinct vectors whose products with the query are all 1."""
    rng = np.random.default_rng(4)
    vectors = np.hstack([np.ones((200, 1)), rng.integers(-4, 5, (200, 15)).astype(float)])
    query = np.zeros((2, 16))
    query[:, 0] = 1.0
    ids = rng.permutation(200) + 1
    near, scores = nearest._best(query, vectors, ids, 20)
    assert ids[near].tolist() == [list(range(1, 21))] * 2 and (scores == 1).all()
    for k in (1, 7, 200, 300):
        assert ids[nearest._best(query, vectors, ids, k)[0]].tolist() == [list(range(1, min(k, 200) + 1))] * 2


def test_best_against_sorting():
    rng = np.random.default_rng(5)
    for n, k in ((1, 3), (40, 7), (300, 21)):
        vectors, queries = rng.integers(-2, 3, (n, 6)).astype(float), rng.integers(-2, 3, (9, 6)).astype(float)
        ids = rng.permutation(n)
        near, scores = nearest._best(queries, vectors, ids, k)
        for query, found, of_found in zip(queries, near, scores, strict=True):
            expected = sorted((-float((query * v).sum()), int(i)) for v, i in zip(vectors, ids, strict=True))[:k]
            assert [(-float(s), int(ids[j])) for j, s in zip(found, of_found, strict=True)] == expected


def test_ties_in_the_query(spark):
    rng = np.random.default_rng(6)
    vectors = np.hstack([np.ones((200, 1)), np.zeros((200, 1)), rng.normal(size=(200, 14))])
    rows = [(0, [1.0] + [0.0] * 15)] + [(i + 1, v.tolist()) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = nearest.nearest(frame, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == [(i, 1.0) for i in range(1, 21)]


def test_structureless_vectors_take_little_disk(spark, monkeypatch):
    """Much of each ordering is near a query there: the query crosses once to each span, not to each block, and as few hits come back."""
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 40)

    def held():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getPath(): found.apply(i).length() for i in range(found.size())}

    vectors = np.random.default_rng(8).normal(size=(4000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    before = held()
    assert nearest.nearest(frame, F.col("vec_id") % 4 == 0).count() == 20_000
    took = sum(size for path, size in held().items() if path not in before)
    assert took < 30e6


@pytest.mark.parametrize("dtype", [np.float32, np.float64])
def test_bytes_compare_as_vectors(dtype):
    rng = np.random.default_rng(9)
    vectors = np.vstack([rng.integers(-1, 2, (200, 3)), rng.normal(size=(200, 3)) * 10.0 ** rng.integers(-30, 30, (200, 1))]).astype(dtype)
    vectors[::7] *= dtype(-1)  # negative zeros
    coded = [row.tobytes() for row in nearest._coded(vectors)]
    assert sorted(range(400), key=lambda i: (coded[i], i)) == sorted(range(400), key=lambda i: (vectors[i].tolist(), i))
    assert (nearest._decoded(b"".join(coded), 3, vectors.itemsize) == vectors).all()


@pytest.mark.parametrize("scale", [1e-200, 1.0, 1e150])
def test_best_of_many_tiles(scale):
    """Ties over many tiles, near ties that single precision cannot tell apart, and numbers beyond its range."""
    rng = np.random.default_rng(10)
    vectors = np.vstack([rng.integers(-1, 2, (3000, 4)), 1 + 1e-9 * rng.integers(0, 50, (500, 4)), rng.normal(size=(500, 4))]) * scale
    vectors, ids = vectors[rng.permutation(4000)], rng.permutation(4000)
    queries = rng.integers(-2, 3, (30, 4)).astype(float) + 0.5
    near, scores = nearest._best(queries, vectors, ids, 21)
    for query, found, of_found in zip(queries, near, scores, strict=True):
        exact = (query * vectors).sum(axis=1)
        order = np.lexsort((ids, -exact))[:21]
        assert (order == found).all() and (exact[order] == of_found).all()


def test_ids_and_vectors_that_come_often(spark):
    """Copies of a table under shifted ids, each row twice, and a few ids with another vector besides."""
    rng = np.random.default_rng(11)
    vectors = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i + 60 * n, vectors[i].tolist()) for i in range(60) for n in range(12) for _ in range(2)]
    more = [(i, (vectors[i] + np.float32(d)).tolist()) for i, d in ((0, 1), (7, -1), (20, -1), (40, 1))]
    got = search(spark, rows + more)
    true = brute_force([(i, v) for i, v in {i: min(v for j, v in rows + more if j == i) for i, _ in rows}.items()])
    assert {q: [(v, s) for _, v, s in best] for q, best in got.items()} == true


def test_spans_have_a_partition_each(spark):
    for n in (1, 7, 96):
        dealt = spark.createDataFrame([(int(i),) for i in nearest._dealt(spark, n)], "deal int").repartition(n, "deal")
        assert dealt.select(F.spark_partition_id()).distinct().count() == n


def test_structureless_vectors_are_compared_whole(spark, monkeypatch):
    """Windows of four orderings would hold more than the table."""
    monkeypatch.setattr(nearest, "BLOCK_ROWS", 100)
    vectors = np.random.default_rng(12).normal(size=(3000, 16))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(vectors / np.linalg.norm(vectors, axis=1, keepdims=True))]
    got, true = search(spark, rows), brute_force(rows)
    assert {q: [(v, s) for _, v, s in best] for q, best in got.items()} == true
