import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from hindsight.llm import manifest as m
from hindsight.llm.queries import op12_merkle_manifest, tampered_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, add=0):
    doc_id, source, lang, n_chars, text = row
    values = [doc_id, source, lang, None if n_chars is None else n_chars + add, text]
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """All levels, one list after the other, as the contract tells it."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def path(levels, i):
    """Per level the run's other node, or nothing, and whether it comes first."""
    found = []
    for nodes in levels[:-1]:
        low = i // 2 * 2
        found.append([(n, j < i) for j, n in enumerate(nodes[low : low + 2], low) if j != i])
        i //= 2
    return found


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    ordered = sorted(groups, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {}
    for lang in ordered:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = tree([leaf(r) for r in groups[lang]])
    top = tree([trees[lang][-1][0] for lang in ordered])
    result = []
    for g, lang in enumerate(ordered):
        for i, row in enumerate(groups[lang]):
            steps = path(trees[lang], i) + path(top, g)
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf(row, 1) if tampered else leaf(row)
            for others in steps:
                before = [n for n, first in others if first]
                node = digest(*before, node, *[n for n, first in others if not first])
            proof = digest(*[n for others in steps for n, _ in others])
            root = top[-1][0]
            result.append((row[0], leaf(row), trees[lang][-1][0], root, proof, node, node == root))
    return sorted(result, key=str)


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


def corpus(n):
    rows = [(i * 3 % 101, f"s{i % 3}", "en", i, "text é " * (i % 4)) for i in range(n)]
    rows += [(i, None, None, None, None) for i in range(5)] + [(None, "s", "en", 3, ""), (None, "s", "de", 3, "x")]
    return rows + rows[:3] * 4 + [(2**60 + i, "a", "éa", 1, "b") for i in range(9)] + [(1, "", "", 0, "")]


@pytest.mark.parametrize("levels", [1, 2, 12])
def test_against_brute_force(spark, levels):
    # Small superblocks make several tiers.
    rows = corpus(40)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(tampered_manifest(frame, levels)) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", 3, "x")], [(i, "a", f"l{i}", 3, "x") for i in range(6)], [(i, "a", "en", 3, "x") for i in range(2)]])
def test_few_rows(spark, rows):
    assert rows_of(tampered_manifest(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_untampered_rows_verify(spark):
    frame = spark.createDataFrame(corpus(10), SCHEMA)
    proved = m.manifest(frame, "doc_id", "lang", ["doc_id", "text"])
    assert proved.where("verified and folded_root = root").count() == frame.count()


def test_changed_rows_are_found(spark):
    frame = spark.createDataFrame(corpus(60), SCHEMA)
    hit = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    expected = frame.where(F.coalesce(hit, F.lit(False))).count()
    assert 0 < expected == tampered_manifest(frame).where("not verified").count()


def test_extra_columns(spark):
    rows = corpus(6)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("?") for n in ("leaf", "tree", "at", "root", "serial")})
    assert rows_of(tampered_manifest(frame)) == brute(rows)


def test_query_returns_all_documents(spark):
    found = op12_merkle_manifest(spark, "/root/testdata/sf0.001")
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(*SCHEMA.replace(" long", "").replace(" string", "").split(", "))
    assert rows_of(found) == brute([tuple(r) for r in documents.collect()])
