"""Document fingerprints from prefix polynomial hashes.

``PrefixHash`` holds, for one text, the prefix sums ``S(i) = sum of (c_j + 1) * B**j for j < i`` modulo two
primes (``c_j`` are code points). From these arrays any span's hash follows by a subtraction and a
multiplication, so two spans are compared in constant time, and the longest common extension of two
positions is found by binary search, since a prefix of equal spans is equal.

A fingerprint keeps the part of the array that content chooses: the prefix sums at those places where the
hash of the next ``WINDOW`` code points is small (one in ``SPACING``), unless such a place lies less than
``WINDOW`` before. The places depend on the text around them alone, not on where it stands, and their number grows
with the text. They cut it into spans whose hashes follow from the kept sums.

Likeness adds up the spans that two texts share, wherever they stand: a span of the one is looked up among
those of the other, and the longest common extension from there is found by binary search over the kept sums.
"""

import hashlib
from functools import cache
from math import ceil
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Batches, BatchesIn, column

#: Code points whose hash makes a place a cut; cuts are at least as far apart.
WINDOW = 12
#: One place in so many is chosen, before those too close to another go.
SPACING = 48
#: Documents that one task has side by side, about; a task streams them, so this bounds no memory.
BUCKET_ROWS = 4_000
#: Buckets are cut at sample quantiles of the ids; the sample is for balance only.
MAX_BUCKETS = 100_000

_PRIMES = np.array([[2147483647], [2147483629]], np.uint64)
_BASES = (1103515245, 1812433253)


#: Code points that are hashed at a time.
_BLOCK = 1 << 16


@cache
def _powers(inverse: bool = False) -> np.ndarray:
    """``B**j`` modulo each prime, or its inverse, for j below ``_BLOCK``, by doubling."""
    powers = np.ones((2, 1), np.uint64)
    while powers.shape[1] < _BLOCK:
        n = powers.shape[1]
        factor = [[pow(b, -n if inverse else n, int(p[0]))] for b, p in zip(_BASES, _PRIMES, strict=True)]
        powers = np.hstack([powers, powers * np.array(factor, np.uint64) % _PRIMES])
    return powers


def _block_sums(points: np.ndarray):
    """For each block of the text, its start and the prefix sums at each of its ends."""
    ahead = np.zeros((2, 1), np.uint64)
    for start in range(0, len(points), _BLOCK):
        some = points[start : start + _BLOCK].astype(np.uint64) + np.uint64(1)
        terms = some * _powers()[:, : len(some)] % _PRIMES
        if start:
            factor = [[pow(b, start, int(p[0]))] for b, p in zip(_BASES, _PRIMES, strict=True)]
            terms = terms * np.array(factor, np.uint64) % _PRIMES
        # Terms are below 2**31 and a block has 2**16 of them, so the sums do not overflow.
        sums = (np.cumsum(terms, axis=1) + ahead) % _PRIMES
        yield start, sums
        ahead = sums[:, -1:]


def _unshifted(sums: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``sums * B**-start`` for the first prime."""
    p, inverse = _PRIMES[0, 0], _powers(inverse=True)[0]
    far = np.array([pow(_BASES[0], -int(b) * _BLOCK, int(p)) for b in np.unique(starts // _BLOCK)], np.uint64)
    which = np.searchsorted(np.unique(starts // _BLOCK), starts // _BLOCK)
    return sums * inverse[starts % _BLOCK] % p * far[which] % p


class PrefixHash:
    """Prefix hashes of one text. Empty spans are equal to each other."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.sums = np.zeros((2, self.n + 1), np.uint64)
        for start, sums in _block_sums(points):
            self.sums[:, start + 1 : start + 1 + sums.shape[1]] = sums

    @classmethod
    def of(cls, text: str | None) -> "PrefixHash":
        return cls(code_points(text))

    def span(self, start: int, end: int) -> int:
        """A hash of the span that does not depend on where it stands."""
        out = []
        for k in range(2):
            p = int(_PRIMES[k, 0])
            shift = pow(_BASES[k], -start, p)
            out.append((int(self.sums[k, end]) - int(self.sums[k, start])) * shift % p)
        return out[0] << 31 | out[1]

    def equal(self, start: int, other: "PrefixHash", at: int, length: int) -> bool:
        return self.span(start, start + length) == other.span(at, at + length)

    def common_extension(self, start: int, other: "PrefixHash", at: int) -> int:
        """Length of the longest span that starts at ``start`` here and at ``at`` there."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")


class Sketch(NamedTuple):
    """What a fingerprint says: the places of all cuts, 0 and the text's end included, the prefix sums of the
    first prime before each of them, and the second prime's sum over all. An empty text has one cut."""

    places: list[int]
    sums: list[int]
    check: int

    def __str__(self) -> str:
        gaps = ".".join(f"{b - a:x}" for a, b in zip(self.places, self.places[1:], strict=False))
        return f"{self.check:08x}-{gaps}-{np.array(self.sums[1:], '>u4').tobytes().hex()}"

    @classmethod
    def parse(cls, fingerprint: str) -> "Sketch":
        check, gaps, sums = fingerprint.split("-")
        places = np.cumsum([0, *(int(g, 16) for g in gaps.split(".") if g)])
        return cls(places.tolist(), [0, *np.frombuffer(bytes.fromhex(sums), ">u4").tolist()], int(check, 16))


def sketch(points: np.ndarray) -> Sketch:
    """Cuts, sums and check of a text, block by block. Beside the text, memory goes with the number of cuts."""
    p, inverse = _PRIMES[0, 0], _powers(inverse=True)[0]
    n, check, last = len(points), 0, -WINDOW
    places, kept = [0], [0]
    before = np.zeros(1, np.uint64)  # the sums before the block's first windows
    for start, sums in _block_sums(points):
        line = np.concatenate([before, sums[0]])
        first = start + 1 - len(before)
        hashes = (line[WINDOW:] + p - line[:-WINDOW]) % p * inverse[: max(0, len(line) - WINDOW)] % p
        if first:
            hashes = hashes * np.uint64(pow(_BASES[0], -first, int(p))) % p
        for i in np.flatnonzero(hashes < p // np.uint64(SPACING)).tolist():
            if i + first - last >= WINDOW and i + first:
                places.append(i + first)
                kept.append(int(line[i]))
            last = i + first
        before, check = line[-WINDOW:], int(sums[1, -1])
    if n:
        places.append(n)
        kept.append(int(before[-1]))
    return Sketch(places, kept, check)


def fingerprint(points: np.ndarray) -> str:
    """``check-gaps-sums`` in hexadecimal: distances between cuts, and 8 digits a prefix sum."""
    return str(sketch(points))


def _spans(of: Sketch) -> list[tuple[int, int]]:
    """Length and hash of each span, the same wherever it stands."""
    places, sums = np.array(of.places, np.int64), np.array(of.sums, np.uint64)
    p = _PRIMES[0, 0]
    hashes = _unshifted((sums[1:] + p - sums[:-1]) % p, places[:-1])
    return list(zip(np.diff(places).tolist(), hashes.tolist(), strict=True))


def _extension(left: Sketch, i: int, right: Sketch, j: int, most: int) -> int:
    """How many spans from the i-th here equal those from the j-th there, by binary search up to ``most``."""
    p = int(_PRIMES[0, 0])
    shift = pow(_BASES[0], right.places[j] - left.places[i], p)

    def equal(count: int) -> bool:
        if left.places[i + count] - left.places[i] != right.places[j + count] - right.places[j]:
            return False
        here, there = left.sums[i + count] - left.sums[i], right.sums[j + count] - right.sums[j]
        return (here * shift - there) % p == 0

    low, high = 1, most
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if equal(middle) else (low, middle - 1)
    return low


def shared(left: Sketch, right: Sketch) -> int:
    """Code points in spans of the one that the other has too, each span as often as both have it."""
    own, others = _spans(left), _spans(right)
    where: dict[tuple[int, int], list[int]] = {}
    for j in reversed(range(len(others))):
        where.setdefault(others[j], []).append(j)
    used = [False] * len(others)
    same = i = 0
    while i < len(own):
        found = where.get(own[i], [])
        while found and used[found[-1]]:
            found.pop()
        if not found:
            i += 1
            continue
        j = found.pop()
        # From here on both go together, up to a span that is taken already.
        count = _extension(left, i, right, j, min(len(own) - i, len(others) - j))
        count = next((k for k in range(1, count) if used[j + k]), count)
        used[j : j + count] = [True] * count
        same += left.places[i + count] - left.places[i]
        i += count
    return same


def _alike(left: Sketch, right: Sketch) -> float:
    if left == right:
        return 1.0
    longer = max(left.places[-1], right.places[-1])
    return min(shared(left, right), longer - 1) / longer


def likeness(left: str, right: str) -> float:
    """Share of the longer text that lies in spans common to both, from 0 to 1, of two fingerprints.

    1 for equal texts, two empty ones included; below 1 for others. A span counts if length and hash are
    equal (31 bits; two unlike texts have the same fingerprint with a probability of about 2**-62).
    """
    return _alike(Sketch.parse(left), Sketch.parse(right))


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)
_RESULT_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _with_next(batches: BatchesIn) -> Batches:
    """Rows come by bucket in order, and each bucket ends with the document that follows it."""

    def results():
        bucket = text = doc = points = own = None
        for batch in batches:
            for next_bucket, follows, next_doc, next_text in zip(
                *(column(batch, c) for c in ("bucket", "follows", "doc_id", "text")), strict=True
            ):
                if follows and next_bucket != bucket:
                    continue  # a second row of the following document
                next_points = code_points(next_text)
                next_own = sketch(next_points)
                if next_bucket == bucket:
                    cut = len(points) // 4
                    edited = np.concatenate([points[: len(points) - cut], next_points[:cut]])
                    changed = sketch(edited)
                    raw = edited.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
                    yield (
                        doc,
                        len(points),
                        hashlib.sha256(raw).hexdigest(),
                        str(own),
                        str(changed),
                        _alike(own, changed),
                        _alike(own, next_own),
                    )
                bucket = None if follows else next_bucket
                doc, points, own = next_doc, next_points, next_own

    rows = []
    for row in results():
        rows.append(row)
        if len(rows) == 2000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _RESULT.types, strict=True)], schema=_RESULT
    )


def _bucket_of(order: Column, cuts: list[int]) -> Column:
    """How many cuts are at or below ``order``."""
    if not cuts:
        return F.lit(0)
    bounds = np.array(cuts, np.int64)

    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right"), dtype="int32")

    return bucket(order)


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has its last quarter (rounded down) replaced by as many first code points of the
    next document, or all it has. Next is by ascending id, rows without one last, equal ids by text; after
    the last comes the first. A single row follows itself. A null text is an empty one. Repeated rows each get
    their row; an empty table gives an empty result; other columns are ignored.

    Texts move once, to buckets of neighbouring ids, and are streamed there in order. The document after a
    bucket's last one comes along as a marked extra row.
    """
    plain = documents.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    order = F.coalesce("doc_id", F.lit(2**63 - 1))
    wanted = max(1, min(MAX_BUCKETS, ceil(plain.count() / BUCKET_ROWS)))
    shares = [i / wanted for i in range(1, wanted)]
    cuts = sorted(set(plain.select(F.percentile_approx(order, shares, max(10_000, 20 * wanted))).first()[0] or [])) if shares else []
    placed = plain.withColumn("bucket", _bucket_of(order, cuts))
    # Where each bucket starts; at most MAX_BUCKETS numbers.
    firsts = sorted((r[0], r[1]) for r in placed.groupBy("bucket").agg(F.min(order)).collect())
    following = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    heads = documents.sparkSession.createDataFrame(following, "first long, before int")
    extra = (
        plain.withColumn("first", order)
        .join(F.broadcast(heads), "first")
        .groupBy("before")
        .agg(F.min(F.struct("first", "text", "doc_id")).alias("head"))
        .select("head.doc_id", "head.text", F.col("before").alias("bucket"), F.lit(True).alias("follows"))
    )
    rows = placed.withColumn("follows", F.lit(False)).unionByName(extra)
    return (
        rows.repartition("bucket")
        .sortWithinPartitions("bucket", "follows", order, "text")
        .mapInArrow(_with_next, _RESULT_DDL)
    )
