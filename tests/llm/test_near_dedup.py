import random

import pytest

from hindsight.llm import near_dedup
from hindsight.llm.common import words


def brute_force(rows):
    """Components over all pairs of the full shingle sets."""
    sets = {}
    for doc, text in rows:
        w = words(text)
        n = min(5, len(w))
        sets[doc] = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
    root = {doc: doc for doc in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            union = len(sets[a] | sets[b])
            if common and 100 * common >= 75 * union:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {doc: (len(s), find(doc), find(doc) == doc) for doc, s in sets.items()}


def result(spark, rows, schema="doc_id long, text string"):
    out = near_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in out}


@pytest.fixture(scope="module")
def rows():
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(30):
        base = random.choices(vocabulary, k=random.randint(3, 120))
        out.append(base)
        for _ in range(random.randint(0, 8)):
            copy = list(base)
            for _ in range(random.randint(0, 3)):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            out.append(copy)
    passage = random.choices(vocabulary, k=60)
    out += [passage + random.choices(vocabulary, k=random.randint(0, 50)) for _ in range(40)]
    random.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


def test_equals_brute_force(spark, rows):
    assert result(spark, rows) == brute_force(rows)


def test_chain_of_links_is_one_component(spark):
    base = [f"t{i}" for i in range(100)]
    rows = [(10 - k, " ".join(base[k * 8 : 60 + k * 8])) for k in range(5)]
    assert result(spark, rows) == brute_force(rows)
    assert len({c for _, c, _ in result(spark, rows).values()}) == 1


def test_odd_texts(spark):
    long = " ".join(f"x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A b"), (5, "a B"), (6, "a b c"), (7, long), (8, long + " y"), (9, "É b"), (10, "é b")]
    got = result(spark, rows)
    assert got == brute_force(rows)
    assert [got[i] for i in (1, 2, 3)] == [(0, i, True) for i in (1, 2, 3)]
    assert got[5] == (1, 4, False) and got[8][1] == 7 and got[10][1] == 10


def test_repeated_rows_nulls_and_clashing_columns(spark):
    rows = [(5, "a b c d e f", 1, "x"), (5, "a b c d e f", 2, "y"), (None, "a b c d e f", 3, "z"), (None, "solo text", 4, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node int, digest string")
    out = sorted(map(tuple, near_dedup.near_duplicates(df).collect()), key=str)
    assert out == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 1, None, True)], key=str)
    stay = near_dedup.without_near_duplicates(df)
    assert stay.columns == df.columns
    assert sorted((r.text, r.doc_id) for r in stay.collect()) == [("a b c d e f", 5), ("solo text", None)]


def test_empty_table(spark):
    assert result(spark, []) == {}


def test_sequential_test_keeps_what_is_similar():
    import numpy as np

    random.seed(1)
    lost = 0
    one = np.zeros(1, int)

    def survives(x, y):
        return near_dedup.sequential_test(near_dedup.signature(x)[None], near_dedup.signature(y)[None], one, one)[0]

    for _ in range(300):
        base = [str(random.random()) for _ in range(200)]
        other = base[:]
        for k in random.sample(range(0, 200, 5), 5):
            other[k] = "z"
        a, b = (near_dedup.shingle_set(" ".join(w)) for w in (base, other))
        similar = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert similar >= 0.75
        lost += not survives(a, b)
    assert lost == 0
    unlike = near_dedup.shingle_set(" ".join(str(random.random()) for _ in range(200)))
    assert not survives(a, unlike)


def test_a_large_group_of_unlike_copies(spark, monkeypatch):
    """Copies that resemble a base, many of them too far from each other."""
    monkeypatch.setattr(near_dedup, "CHUNK", 40)
    monkeypatch.setattr(near_dedup, "MORE_PIVOTS", 3)
    random.seed(11)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(150):
        text = list(base)
        for k in random.sample(range(120), random.randint(0, 9)):
            text[k] = f"n{i}-{k % 3}"
        rows.append((1000 - i, " ".join(text)))
    assert result(spark, rows) == brute_force(rows)
