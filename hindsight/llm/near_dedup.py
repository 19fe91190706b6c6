"""MinHash near-duplicates, candidates verified by sequential Bayesian tests and then exactly.

1. Each text becomes the set of its 5-word shingles and a MinHash signature. Texts with equal sets
   form a class; one of each class goes on.
2. Signatures are cut into bands. Classes that agree in a whole band share a bucket.
3. In a bucket not all pairs are built. First those members go that have so many shingles of their own
   that no text of the bucket can be similar enough. Then the most central member (that with the
   fewest shingles of its own), the pivot, is compared with every other, then more pivots (32, 1024, ...) with the members that are left, and no
   pair is compared whose two sides are already connected. Large buckets are dealt to chunks. A pivot leaves its bucket once it has met
   all the others, a bucket is done when its members are in one component. So every pair of a bucket
   is compared, known to be connected, or too unlike by its bound, whatever the bucket's size, and a
   group of copies costs about one row each.
4. A pair's signatures are compared batch by batch. After each batch the posterior probability that
   the similarity reaches the threshold, given the matches so far, decides: below ``miss`` the pair
   is dropped and costs no more.
5. What survives is confirmed on the full shingle sets.
"""

from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, BatchesIn, column, list_array, small, words, written
from .components import connected_components

SHINGLE = 5
BANDS = 32
ROWS = 4
#: The first ``BANDS * ROWS`` hashes make the bands, all are compared.
HASHES = 256
BATCH = 32
#: A pair at the similarity threshold is lost with about this probability in the sequential test.
MISS = 1e-5
#: Members of a bucket that one task compares with the pivots, about.
CHUNK = 4096
#: By so much the number of pivots grows with each round.
MORE_PIVOTS = 32
#: Similarity of at least 75 in 100.
PERCENT = 75

_FOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
_CHUNK = 4096


@cache
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20240501)
    a, b = random.integers(0, 2**64, (2, HASHES, 1), dtype=np.uint64)
    return a | np.uint64(1), b


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles.

    Fewer than five words make one shingle of the whole sequence; no words (null, empty or white
    space) make an empty set.
    """
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    width = min(SHINGLE, len(found))
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    folded = np.full(len(found) - width + 1, width, np.uint64)
    for i in range(width):
        folded = folded * _FOLD + hashes[i : len(found) - width + 1 + i]
    folded = (folded ^ (folded >> _SHIFT)) * _MIX
    return np.unique(folded ^ (folded >> _SHIFT))


def signature(shingles: np.ndarray) -> np.ndarray:
    a, b = _multipliers()
    least = np.full(HASHES, 2**64 - 1, np.uint64)
    for start in range(0, len(shingles), _CHUNK):  # bounded memory for very long texts
        np.minimum(least, (a * shingles[start : start + _CHUNK] + b).min(axis=1), out=least)
    return (least >> _SHIFT).astype(np.uint32).view(np.int32)


_SIGNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_key", pa.int64()),
        ("n_shingles", pa.int64()),
        ("digest", pa.string()),
        ("sig", pa.list_(pa.int32())),
    ]
)
_SIGNED_DDL = "doc_id long, text_key long, n_shingles long, digest string, sig array<int>"


def _sign(batches: BatchesIn) -> Batches:
    for batch in small(batches):
        sizes, digests, signatures = [], [], []
        for text in column(batch, "text"):
            shingles = shingle_set(text)
            sizes.append(len(shingles))
            digests.append(xxhash.xxh3_128_hexdigest(shingles.tobytes()) if len(shingles) else None)
            signatures.append(signature(shingles))
        flat = np.concatenate(signatures) if signatures else np.empty(0, np.int32)
        yield pa.RecordBatch.from_arrays(
            [
                *batch.select(["doc_id", "text_key"]).columns,
                pa.array(sizes, pa.int64()),
                pa.array(digests, pa.string()),
                list_array(np.arange(len(sizes) + 1) * HASHES, pa.array(flat)),
            ],
            schema=_SIGNED,
        )


_SETS = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def _shingle_rows(batches: BatchesIn) -> Batches:
    for batch in small(batches):
        sets = [shingle_set(text).view(np.int64) for text in column(batch, "text")]
        offsets = np.cumsum([0, *map(len, sets)])
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        ids = batch.column(batch.schema.get_field_index("doc_id")).cast(pa.int64())
        yield pa.RecordBatch.from_arrays([ids, list_array(offsets, pa.array(flat))], schema=_SETS)


@cache
def least_matches(percent: int = PERCENT, miss: float = MISS) -> tuple[int, ...]:
    """For each batch end ``n``: the fewest matches of ``n`` hashes that keep a pair.

    With a uniform prior the similarity is Beta(m + 1, n - m + 1) after m matches of n, and the
    probability that it reaches t is that of at most m successes in n + 1 trials of chance t.
    """
    t = percent / 100
    kept = []
    for n in range(BATCH, HASHES + 1, BATCH):
        reach = 0.0
        for m in range(n + 1):
            reach += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
            if reach >= miss:
                kept.append(m)
                break
    return tuple(kept)


def sequential_test(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows ``i`` of one and ``j`` of another signature matrix survive all batches.

    Dropped pairs cost no more.
    """
    alive = np.arange(len(i))
    matches = np.zeros(len(i), np.int64)
    for k, least in enumerate(least_matches()):
        batch = slice(k * BATCH, (k + 1) * BATCH)
        matches[alive] += (left[i[alive], batch] == right[j[alive], batch]).sum(axis=1)
        alive = alive[matches[alive] >= least]
    out = np.zeros(len(i), bool)
    out[alive] = True
    return out


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_MEMBER = ("bucket", "chunk", "is_pivot", "band", "node", "root", "n", "own")


def _possible(pivot: dict, member: dict) -> tuple[np.ndarray, np.ndarray]:
    """Indices of pairs that are not connected yet and that their sizes allow to be similar enough."""
    p, m = (lambda c: pivot[c][:, None]), (lambda c: member[c][None, :])
    shared = np.minimum(p("n") - p("own"), m("n") - m("own"))
    later = (m("own") > p("own")) | (m("own") == p("own")) & (m("node") > p("node"))
    return np.nonzero(later & (p("root") != m("root")) & (100 * shared >= PERCENT * (p("n") + m("n") - shared)))


def _compare(pivot: dict, member: dict) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the bucket that survive the sequential test.

    A pair that shares several bands is left to the bucket of the first.
    """
    left, right = [], []
    for low in range(0, len(pivot["node"]), 64):
        some = {c: x[low : low + 64] for c, x in pivot.items()}
        i, j = _possible(some, member)
        for start in range(0, len(i), 1 << 14):
            a, b = i[start : start + (1 << 14)], j[start : start + (1 << 14)]
            keep = np.flatnonzero(sequential_test(some["sig"], member["sig"], a, b))
            a, b = a[keep], b[keep]
            same = some["sig"][a, : BANDS * ROWS] == member["sig"][b, : BANDS * ROWS]
            same = same.reshape(-1, BANDS, ROWS).all(axis=2)
            first = same.argmax(axis=1) == member["band"][b]
            left.append(some["node"][a[first]])
            right.append(member["node"][b[first]])
    none = np.empty(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def _bucket_pairs(batches: BatchesIn) -> Batches:
    """Rows come by bucket and chunk, pivots first; members pass by in batches."""
    now, pivots = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in _MEMBER}
        rows["sig"] = batch.column(batch.schema.get_field_index("sig")).flatten().to_numpy().reshape(-1, HASHES)
        owner = np.stack([rows["bucket"], rows["chunk"].astype(np.int64), rows["is_pivot"].astype(np.int64)])
        ends = np.flatnonzero((owner[:, 1:] != owner[:, :-1]).any(axis=0)) + 1
        found = []
        for low, high in zip([0, *ends], [*ends, batch.num_rows], strict=True):
            part = {c: x[low:high] for c, x in rows.items()}
            group = (part["bucket"][0], part["chunk"][0])
            if group != now:
                now, pivots = group, []
            if part["is_pivot"][0]:
                pivots.append(part)
            elif pivots:
                if len(pivots) > 1:
                    pivots = [{c: np.concatenate([p[c] for p in pivots]) for c in part}]
                found.append(_compare(pivots[0], part))
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else ([], [])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_PAIR)


def _candidates(rest: DataFrame, signatures: DataFrame, pivots: int) -> tuple[DataFrame, DataFrame]:
    """Pairs ``(a, b)`` of this round's pivots with the other members that survive the sequential
    test, and the pivots. A large bucket's members are dealt to chunks, its pivots go to each."""
    chosen = written(
        rest.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy("own", "node")))
        .where(F.col("rank") <= pivots)
        .drop("rank"),
        "pivots",
    )
    chunks = rest.groupBy("bucket").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    members = rest.join(chunks, "bucket").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
    own = chosen.join(chunks, "bucket").select(*chosen.columns, "chunks", every)
    rows = members.withColumn("is_pivot", F.lit(False)).unionByName(own.withColumn("is_pivot", F.lit(True)))
    pairs = (
        rows.join(signatures, "node")
        .select(*_MEMBER, "sig")
        .repartition("bucket", "chunk")
        .sortWithinPartitions("bucket", "chunk", F.desc("is_pivot"))
        .mapInArrow(_bucket_pairs, "a long, b long")
    )
    return pairs.distinct(), chosen


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose shingle sets overlap enough. One member's set travels to the pivot's."""
    left, right = (sets.select(F.col("node").alias(s), F.col("shingles").alias(f"set_{s}")) for s in "ab")
    common = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - common
    return pairs.join(right, "b").join(left, "a").where(100 * common >= PERCENT * union).select("a", "b")


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for each row of ``documents``.

    Rows are linked when their shingle sets have a Jaccard similarity of 0.75 or more; a component
    is what links reach, named by its least id, and ``kept`` marks the document with that id.

    Null, empty and wordless texts have no shingles, are linked with nothing and kept. Rows that
    repeat an id count as one document: they share its component, and each of them is returned.
    A row without an id gets the component its text belongs to, is kept only where that component
    has no id at all (then ``component_id`` is null), and links nothing further. Other columns are
    ignored; an empty table gives an empty result. Very long texts are processed whole.
    """
    return _placed(documents, id_col, text_col).drop("text_key")


def _placed(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    plain = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text"),
        F.xxhash64(F.col(text_col)).alias("text_key"),
    )
    signed = written(plain.mapInArrow(_sign, _SIGNED_DDL), "signatures")

    classes = written(
        signed.where("digest is not null")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
        .where("node is not null"),
        "classes",
    )
    keys = [F.xxhash64(F.lit(i), *[F.col("sig")[i * ROWS + j] for j in range(ROWS)]) for i in range(BANDS)]
    bands = classes.select(F.posexplode(F.array(*keys)).alias("band", "bucket"), "node")
    shared = (
        bands.groupBy("bucket")
        .agg(F.min("node").alias("low"), F.max("node").alias("high"))
        .where("low < high")
        .select("bucket")
    )
    # Buckets of one class need no more thought; few rows are left.
    members = written(bands.join(shared, "bucket", "left_semi"), "buckets")
    live = members.select("node").distinct()
    signatures = written(classes.join(live, "node", "left_semi").select("node", "sig"), "live-signatures")
    sets = written(
        plain.join(live, plain["doc_id"] == live["node"], "left_semi")
        .dropDuplicates(["doc_id", "text_key"])
        .mapInArrow(_shingle_rows, "node long, shingles array<long>"),
        "shingles",
    )
    rest = _plausible(members, sets)
    roots = None
    pivots = 1
    while True:
        rest = written(_unfinished(rest, roots), "buckets")
        if rest.isEmpty():
            break
        pairs, chosen = _candidates(rest, signatures, pivots)
        found = written(_verified(pairs, sets), "links")
        rest = rest.join(chosen.select("bucket", "node"), ["bucket", "node"], "left_anti").drop("root")
        if not found.isEmpty():
            known = roots.select(F.col("root").alias("a"), F.col("node").alias("b")) if roots else found
            roots = connected_components(known.unionByName(found))
        pivots *= MORE_PIVOTS

    if roots is None:
        roots = classes.where(F.lit(False)).select("node", F.col("node").alias("root"))
    nodes = classes.select("digest", "node").join(roots, "node", "left")
    component = F.coalesce("root", "node", "doc_id")
    return (
        signed.select("doc_id", "text_key", "n_shingles", "digest")
        .join(nodes, "digest", "left")
        .select("doc_id", "text_key", "n_shingles", component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def _plausible(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``(bucket, band, node, n, own)`` without members that cannot be linked to any other of their bucket.

    ``own`` counts the shingles that no other text has. They are in no intersection, so with at most
    ``n - own`` in common and a union of at least ``n`` plus what the smallest member has beyond that,
    the similarity is bounded. Heavily edited copies, which resemble all of a large group without
    reaching the threshold with any, go here, before any pair is built.
    """
    single = (
        sets.select(F.explode("shingles").alias("shingle"), "node")
        .groupBy("shingle")
        .agg(F.count("*").alias("seen"), F.min("node").alias("node"))
        .where("seen = 1")
        .groupBy("node")
        .agg(F.count("*").alias("own"))
    )
    facts = sets.select("node", F.size("shingles").cast("long").alias("n")).join(single, "node", "left")
    known = written(members.join(facts.fillna(0, ["own"]), "node"), "buckets")
    least = known.groupBy("bucket").agg(F.min("n").alias("least"))
    common = F.col("n") - F.col("own")
    enough = 100 * common >= PERCENT * (F.col("n") + F.greatest("least", common) - common)
    return known.join(least, "bucket").where(enough).select("bucket", "band", "node", "n", "own")


def _unfinished(rest: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members, with their component, of the buckets that still hold more than one component."""
    placed = rest.join(roots, "node", "left") if roots else rest.withColumn("root", F.col("node"))
    placed = placed.select("bucket", "band", "node", "n", "own", F.coalesce("root", "node").alias("root"))
    several = (
        placed.groupBy("bucket")
        .agg(F.min("root").alias("low"), F.max("root").alias("high"))
        .where("low < high")
        .select("bucket")
    )
    return placed.join(several, "bucket", "left_semi")


def without_near_duplicates(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay: one of each group of near-duplicates, all columns.

    Rows equal in id and text are one document and leave one row; of rows that share an id but not
    the text each stays. A row without an id stays where its text is linked with no row that has one.
    """
    kept = _placed(documents).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
    same = documents["doc_id"].eqNullSafe(kept["_id"]) & (F.xxhash64(documents["text"]) == kept["_key"])
    return documents.join(kept.distinct(), same, "left_semi").dropDuplicates(["doc_id", "text"])
