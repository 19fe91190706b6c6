import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from hindsight.llm import collocations as c

SCHEMA = "doc_id long, lang string, text string"
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def brute(rows, least=10, longest=3, share=50, top=2000):
    counts = defaultdict(Counter)
    totals = Counter()
    for _, lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    result = []
    for lang, n in totals.items():
        f = counts[lang]
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in candidates.items():
            longer = [
                b for q, b in candidates.items()
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            ]
            if any(100 * b >= share * a for b in longer):
                continue
            score, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(result)


def corpus(rng, rows=120):
    words = ["New", "york", "city", "of", "the", "Été", "a", "b", "x y", "end"]
    made = []
    for i in range(rows):
        picks = rng.choice(words, rng.integers(0, 60), p=[0.2, 0.2, 0.1, 0.1, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05])
        text = "".join(w + rng.choice([" ", "\t", ", ", ".", "\n", "  ", " "], p=[0.6, 0.1, 0.1, 0.05, 0.05, 0.05, 0.05]) for w in picks)
        made.append((i, rng.choice(["en", "fr", None, "und"]), text))
    return made + [(None, "en", None), (7, None, ""), (8, "de", " ,. \n"), made[0], made[0]]


@pytest.mark.parametrize("settings", [{}, {"least": 3, "longest": 4}, {"longest": 2, "top": 4}, {"share": 10, "top": 5}])
def test_against_brute_force(spark, settings):
    rows = corpus(np.random.default_rng(5))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = c.collocations(frame, **settings)
    assert found.columns == COLUMNS
    expected = brute(rows, **settings)
    assert sorted(map(tuple, found.collect())) == expected and len(expected) > 8


def test_chunks_do_not_show(spark, monkeypatch):
    rows = corpus(np.random.default_rng(6))
    texts = [(lang or "und", text) for _, lang, text in rows if text]

    def counts(chunk):
        monkeypatch.setattr(c, "CHUNK_BYTES", chunk)
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"lang": [t[0] for t in texts], "text": [t[1] for t in texts]})
        total = Counter()
        for out in c._counted([batch], 3, 7):
            for row in out.to_pylist():
                for line, n in zip(row["windows"].split("\n"), row["counts"], strict=True):
                    total[row["lang"], *line.split(" ")] += n
        return total

    whole = counts(10**9)
    assert counts(50) == counts(1) == whole
    # One window for every word, whatever the chunks.
    assert sum(whole.values()) == sum(r[6] for r in {(r[0], r[6]): r for r in brute(rows, least=1)}.values())


@pytest.mark.parametrize("distinct", [60, 2**20, 2**25, 2**31])
@pytest.mark.parametrize("longest", [2, 3, 5])
def test_windows_of_large_vocabularies(distinct, longest):
    rng = np.random.default_rng(longest)
    names = np.sort(rng.choice(distinct, 12, replace=False))
    codes = names[rng.integers(0, 12, 400)]
    end = int(names[3])
    expected = Counter()
    for i in np.flatnonzero(codes != end):
        piece = list(codes[i : i + longest])
        piece = piece[: piece.index(end)] if end in piece else piece
        expected[tuple(map(int, piece)) + (end,) * (longest - len(piece))] += 1
    columns, counts = c.windows(codes, end, distinct, longest)
    assert dict(zip(zip(*[map(int, column) for column in columns], strict=True), map(int, counts), strict=True)) == expected


def test_long_text_and_frequent_pair(spark):
    rows = [(1, "en", "big deal " * 30_000), (2, "en", "other big deal. " * 20), (3, "fr", "oh la la, " * 12)]
    found = c.collocations(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, found.collect())) == brute(rows)


def test_scores_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    a, left, right = 3 * 10**13 + 7, 4 * 10**13 + 1, 3 * 10**13 + 9
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    assert row.select(c._score(F.col("a"), F.col("l"), F.col("r"))).head()[0] == 10**6 * a * a // (left * right)


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert c.collocations(empty).collect() == []
    rows = [(1, "en", "a b " * 10, "x", 1)]
    odd = spark.createDataFrame(rows, "doc_id long, lang string, text string, phrase string, n long")
    assert sorted(map(tuple, c.collocations(odd).collect())) == brute([r[:3] for r in rows])
