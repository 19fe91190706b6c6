import hashlib
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hindsight.llm import fingerprints
from hindsight.llm.fingerprints import PrefixHash, Sketch, code_points, fingerprint, likeness, sketch

ALPHABET = st.text(alphabet="abé\U0001f600", max_size=300)


@settings(max_examples=60, deadline=None)
@given(a=ALPHABET, b=ALPHABET, data=st.data())
def test_spans_and_extensions(a, b, data):
    left, right = PrefixHash.of(a), PrefixHash.of(b)
    i, j = data.draw(st.integers(0, len(a))), data.draw(st.integers(0, len(b)))
    n = data.draw(st.integers(0, min(len(a) - i, len(b) - j)))
    assert left.equal(i, right, j, n) == (a[i : i + n] == b[j : j + n])
    true = 0
    while i + true < len(a) and j + true < len(b) and a[i + true] == b[j + true]:
        true += 1
    assert left.common_extension(i, right, j) == true


def test_blocks_do_not_show(monkeypatch):
    text = "".join(random.Random(1).choices("abc", k=1000))
    whole = fingerprint(code_points(text))
    sums = PrefixHash.of(text).sums
    fingerprints._powers.cache_clear()
    monkeypatch.setattr(fingerprints, "_BLOCK", 64)
    assert fingerprint(code_points(text)) == whole
    assert (PrefixHash.of(text).sums == sums).all()
    fingerprints._powers.cache_clear()


def plain_spans(text):
    """The spans of a text from its windows one by one."""
    p, base, w = 2147483647, 1103515245, fingerprints.WINDOW
    small = [
        sum((ord(c) + 1) * pow(base, j, p) for j, c in enumerate(text[i : i + w])) % p < p // fingerprints.SPACING
        for i in range(len(text) - w + 1)
    ]
    cuts = [i for i, chosen in enumerate(small) if i and chosen and not any(small[max(0, i - w + 1) : i])]
    ends = [0, *cuts, len(text)]
    return Counter(text[a:b] for a, b in zip(ends, ends[1:], strict=False) if b > a)


def plain_likeness(x, y):
    same = plain_spans(x) & plain_spans(y)
    longer = max(len(x), len(y))
    return 1.0 if x == y else min(sum(len(s) * n for s, n in same.items()), longer - 1) / longer


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=8), st.lists(st.integers(0, 5), max_size=8), ALPHABET, ALPHABET)
def test_likeness_is_that_of_shared_spans(some, others, a, b):
    rng = random.Random(3)
    blocks = ["".join(rng.choices("abcé😀 ", k=k)) for k in (5, 90, 150, 200, 260, 400)]
    x, y = "".join(blocks[i] for i in some) + a, b + "".join(blocks[i] for i in others)
    left, right = (fingerprint(code_points(t)) for t in (x, y))
    got = likeness(left, right)
    assert got == pytest.approx(plain_likeness(x, y))
    assert 0 <= got <= 1 and (got == 1) == (x == y) == (left == right)
    assert got == pytest.approx(likeness(right, left))


@pytest.mark.parametrize("text", ["", "a", "a" * 5000, "ab" * 3000, "no window"])
def test_uniform_and_short_texts(text):
    own = sketch(code_points(text))
    assert Sketch.parse(str(own)) == own and own.places[-1] == len(text)
    assert all(b - a >= fingerprints.WINDOW for a, b in zip(own.places[:-1], own.places[1:-1], strict=False))
    assert likeness(str(own), str(own)) == 1
    assert likeness(str(own), fingerprint(code_points(text + "x"))) < 1


def expected(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    out = []
    for k, (doc, text) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + other[:cut]
        a, b, c = (fingerprint(code_points(t)) for t in (text, edited, other))
        out.append((doc, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    return out


def result(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, bucket int").repartition(3)
    return sorted(map(tuple, fingerprints.fingerprints(df).collect()), key=str)


def test_whole_table(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 7)
    random.seed(4)
    rows = [(random.randrange(-50, 10**6), "".join(random.choices("abcdé😀\n ", k=random.randint(0, 400)))) for _ in range(100)]
    rows += [(10**7, None), (10**7 + 1, ""), (10**7 + 2, "z" * 200_000), (None, "no id"), (None, "other"), rows[3], (rows[4][0], "again")]
    got = result(spark, rows)
    assert got == sorted(expected(rows), key=str)
    longest = next(r for r in got if r[1] == 200_000)
    assert len(longest[3]) < 100  # one letter all along has no cuts to choose from


@pytest.mark.parametrize("rows", [[], [(1, "alone in the table")], [(1, None)], [(None, "x"), (None, "x")], [(5, "same")] * 9])
def test_small_tables(spark, rows):
    assert result(spark, rows) == sorted(expected(rows), key=str)


def words(rng, n):
    return "".join(rng.choices("abcdef ", k=n))


def test_edits_show_by_their_size():
    rng = random.Random(8)
    text = words(rng, 10_000)
    own = fingerprint(code_points(text))

    def near(other):
        return likeness(own, fingerprint(code_points(other)))

    assert 0.7 < near(text[:7500] + words(rng, 2500)) <= 0.76
    assert near("A header. " + text + " A footer.") > 0.95  # both ends differ
    assert near("X" + text[1:-1] + "X") > 0.95
    assert near(text[:1000] + "X" + text[1001:9000] + "Y" + text[9001:]) > 0.95
    assert near(text[5000:] + text[:5000]) > 0.95  # moved, not lost
    assert 0.4 < near(words(rng, 2500) + text[2500:7500] + words(rng, 2500)) < 0.55
    assert near(words(rng, 10_000)) < 0.02


def test_cuts_grow_with_the_text():
    rng = random.Random(9)
    counts = [len(sketch(code_points(words(rng, n))).places) for n in (5_000, 50_000, 500_000)]
    assert 8 < counts[1] / counts[0] < 12.5 and 9 < counts[2] / counts[1] < 11


def test_a_passage_shared_with_the_next_document(spark):
    rng = random.Random(10)
    passage = words(rng, 900)
    texts = [words(rng, 300) + passage + words(rng, 300), words(rng, 600) + passage, words(rng, 1500)]
    near = {r[0]: r[6] for r in result(spark, list(enumerate(texts)))}
    assert 0.45 < near[0] < 0.61 and near[1] < 0.05
