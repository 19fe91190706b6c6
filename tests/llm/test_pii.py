import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hindsight.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def expected(text):
    spans = [
        (kind, m.start(), m.end())
        for kind, pattern in PLAIN.items()
        for m in re.finditer(pattern, text or "")
        if valid(kind, m[0])
    ]
    counts = tuple(sum(s[0] == kind for s in spans) for kind in PLAIN)
    return counts, ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found(spark, rows):
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in rows], "doc_id long, text string, _text string, _email array<int>")
    return pii.personal_data(df).collect()


def compare(spark, texts):
    out = {r.doc_id: r for r in found(spark, list(enumerate(texts)))}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        counts, base = expected(text)
        r = out[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == counts, repr(text)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest(), repr(text)
        spans = r.spans.split(",") if r.spans else []
        assert set(base.split(",") if base else []) <= set(spans)
        order = [(list(PLAIN).index(s.split(":")[0]), int(s.split(":")[1])) for s in spans]
        assert order == sorted(order)


TEXTS = [
    None, "", "a@b.c_d@e.f", "a@b.c@d.e", "x a@b.c. y@z..w", "..%@-.-", "1.2.3.4.5.6.7.8", "999.1.1.1 0255.1.1.1 256.1.1.1", "1.2.3.4 12.34.56.78",
    "4111 1111 1111 1111", "4111-1111-1111-1111 2", "1 4111 1111 1111 1111", "4111  1111", "4111111111111112", "12345678901234567890",
    "+1 (017) 555-7713 r", "+12345678", "+1....9", "++49 30 1234567 8", "+1 (555) 123 45 67 89 01 23 45 67", "é😀 a@b.co 😀+1 (201) 555-0123",
    "1" * 30_000, "a" * 50_000, "a@" * 20_000, "1 " * 20_000, "+1" + " " * 20_000, "1." * 20_000, "6011-0009 9013-9424", "00000000000000", "0-0-0-0-0-0-0-0-0-0-0-0-0",
]


def test_base_spans(spark):
    random.seed(6)
    pieces = ["a", "b.c", "@", ".", "1", "12", "255", "256", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "x@y.de", "10.0.0.1", "\n", "é", "😀", "_", "%", "+49 30 123456", "4242424242424242"]
    texts = TEXTS + ["".join(random.choices(pieces, k=random.randint(1, 30))) for _ in range(1500)]
    compare(spark, texts)


def test_learns_what_the_base_patterns_miss(spark):
    random.seed(3)
    rows = []
    for i in range(300):
        kind = i % 6
        if kind == 0:
            text = f"please contact user{i}@site{i % 9}.org today"
        elif kind == 1:
            text = f"write to jo.{i} (at) mail{i % 5} (dot) com"
        elif kind == 2:
            text = f"call +49 30 {random.randint(1000000, 9999999)} now"
        elif kind == 3:
            text = f"phone 030 {random.randint(100, 999)} {random.randint(1000, 9999)} please"
        elif kind == 4:
            text = f"version 2024.10.{random.randint(10, 28)} page {random.randint(1000000, 9999999)}"
        else:
            text = "nothing to see here"
        rows.append((i, text))
    spans = {r.doc_id: r.spans for r in found(spark, rows)}
    share = lambda kind: sum(bool(spans[i]) for i, _ in rows if i % 6 == kind) / 50
    assert [share(k) == 1 for k in (0, 2)] == [True, True]
    assert share(1) > 0.9 and share(3) > 0.9
    assert share(4) == 0 and share(5) == 0


def test_reliable_labelers_are_found():
    random.seed(9)
    counts = {}
    for _ in range(5000):
        y = random.random() < 0.3
        good = lambda p: (1 if y else -1) if random.random() < p else (-1 if y else 1)
        votes = (good(0.95), good(0.9), good(0.8), random.choice([-1, 0, 1]))
        counts[votes] = counts.get(votes, 0) + 1
    share, tables, _ = pii.reliabilities(sorted(counts.items()))
    assert share == pytest.approx(0.3, abs=0.03)
    assert tables[0][1, 1] == pytest.approx(0.95, abs=0.03) and tables[3][1, 1] == pytest.approx(1 / 3, abs=0.05)


def test_masks(spark):
    rows = [(1, "mail a@b.co or 10.0.0.1 😀 +1 (201) 555-0123.", "en", 0), (2, None, "en", 5), (3, "clean", "de", 5), (3, "clean", "de", 5), (4, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _spans string, n_chars long")
    out = pii.masked_documents(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = sorted(map(tuple, out.collect()), key=str)
    masked = "mail <email> or <ip> 😀 <phone>."
    assert got == sorted([(1, masked, "en", len(masked)), *rows[1:]], key=str)


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    for df in (pii.personal_data(docs), pii.masked_documents(docs)):
        plan = df._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def test_empty_and_repeated(spark):
    assert found(spark, []) == []
    out = found(spark, [(1, "a@b.co"), (1, "a@b.co"), (None, "a@b.co")])
    assert len(out) == 3 and {r.spans for r in out} == {"email:0:6"}


@settings(max_examples=5, deadline=None)
@given(texts=st.lists(st.text(alphabet="a1@.+- ()é_", max_size=40), min_size=1, max_size=80))
def test_any_text(spark, texts):
    compare(spark, texts)
