"""Approximate nearest neighbours by inner product, on shifted Hilbert curves.

1. Equal vectors are one class with its smallest id, so copies cost nothing and ties come out right. They are
   known by a digest of 128 bits: vectors cross no exchange here, but those of ids that have several rows or copies
   if these are many.
2. Vectors are lengthened by one coordinate to equal norm (the usual reduction of inner product to
   distance; it is zero for unit vectors). Each of several orderings projects them at random to a few
   dimensions, shifts the grid, and sorts by position on a Hilbert curve. Low bits of a hash follow,
   so that no key is shared by many vectors.
3. Each ordering is cut into blocks, and spans of neighbouring blocks. A query visits its own block and ``radius``
   blocks to either side. A task holds one span and streams the queries that visit any of its blocks, each once.
4. Per query the ``k`` best of each span are merged. Products in single precision sort out what cannot be among them,
   with a margin for their rounding; the rest is scored on the original vectors in double precision.

The radius is measured, not guessed: a fixed number of pilot queries is compared with all vectors,
and the radius is the least that finds ``TARGET`` of their true neighbours. Where neighbours are
near each other on the curves, as in clustered data, windows are short. Data without structure makes them
a fixed share of the table, as no index can tell there what is near without looking at most of it. Where the windows
of all orderings together hold more than the table, one ordering is visited from end to end instead: that takes
less, sees every pair once, and the result is exact.
"""

from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import Batches, BatchesIn, written

ORDERINGS = 4
DIMENSIONS = 6
BITS = 7
#: Bits of a hash below the curve's position.
TAIL_BITS = 20
BLOCK_ROWS = 2048
#: Blocks of one ordering; their cuts are sent to every task.
MAX_BLOCKS = 100_000
#: Vectors that a task holds, and the spans of an ordering that has as many blocks.
SPAN_BYTES = 1 << 27
SPANS = 24
PILOTS = 100
TARGET = 0.96


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of points with whole coordinates below ``2**bits``, by row.

    The coordinates' bits are turned into the curve's by undoing, from the top bit down, the
    exchanges and reflections of the cells, and by a Gray code over all dimensions.
    """
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        bit, below = 1 << level, (1 << level) - 1
        for i in range(dims):
            high = (x[i] & bit) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(high, below, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> level) & 1, (1 << level) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> level) & 1
    return out


@cache
def _projections(dim: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """A matrix per ordering, for the vector and its added coordinate, and a shift within a cell."""
    random = np.random.default_rng(seed)
    rotations = [np.linalg.qr(random.normal(size=(dim + 1, dim + 1)))[0] for _ in range(ORDERINGS)]
    wide = np.stack([r[:, np.arange(DIMENSIONS) % (dim + 1)] for r in rotations])
    return wide, random.uniform(0, 1, (ORDERINGS, 1, DIMENSIONS))


def _coded(vectors: np.ndarray) -> np.ndarray:
    """Numbers as big-endian unsigned ones in the same order, so that bytes compare as vectors do."""
    kind = np.dtype(f"u{vectors.itemsize}")
    top = kind.type(1 << (8 * vectors.itemsize - 1))
    bits = (vectors + vectors.dtype.type(0)).view(kind)  # no negative zeros
    return np.where(bits & top, ~bits, bits | top).astype(kind.newbyteorder(">"))


def _decoded(data, dim: int, size: int) -> np.ndarray:
    bits = np.frombuffer(data, f">u{size}").astype(f"u{size}")
    top = bits.dtype.type(1 << (8 * size - 1))
    return np.where(bits & top, bits ^ top, ~bits).view(f"f{size}").reshape(-1, dim)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Pieces of ``data`` that end at ``ends``, in bytes."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def _bytes(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where its values begin and end."""
    values = batch.column(batch.schema.get_field_index(name))
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class _Form:
    """How vectors are stored: the dimension, and the bytes of a number."""

    def __init__(self, dim: int, size: int):
        self.dim, self.size = dim, size

    def vectors(self, batch: pa.RecordBatch) -> np.ndarray:
        return _decoded(_bytes(batch, "vector")[0], self.dim, self.size)

    def decoded(self, vector: bytes) -> np.ndarray:
        return _decoded(vector, self.dim, self.size)[0]


def _smallest(rows: DataFrame, several: DataFrame) -> DataFrame:
    """The rows, with one in place of those of an id among ``several``: its smallest vector."""
    least = (
        rows.join(several, "vec_id", "left_semi")
        .groupBy("vec_id")
        .agg(F.min(F.struct("vector", "norm2", "h1", "h2")).alias("least"), F.max("asks").alias("asks"))
        .select("vec_id", "asks", "least.*")
    )
    return rows.join(several, "vec_id", "left_anti").unionByName(least)


_ROWS_DDL = "vec_id long, asks boolean, vector binary, dim int, norm2 double, h1 long, h2 long"


def _usable(plain: DataFrame) -> DataFrame:
    """Rows whose vectors are finite and not zero."""

    def rows(batches: BatchesIn) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.schema.get_field_index("embedding"))
            lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            values = lists.flatten().to_numpy(zero_copy_only=False)  # nulls are NaN
            starts = np.cumsum(lengths, dtype=np.int64) - lengths
            ids, asks = _numbers(batch, "vec_id"), _numbers(batch, "asks")
            for dim in np.unique(lengths[lengths > 0]):
                some = np.flatnonzero(lengths == dim)
                own = values.reshape(-1, dim) if len(some) == len(ids) else values[starts[some][:, None] + np.arange(dim)]
                fine = np.isfinite(own).all(axis=1) & (own != 0).any(axis=1)
                some, own = some[fine], own[fine]
                if not len(some):
                    continue
                coded = _coded(own)
                raw, width = memoryview(coded.tobytes()), own.itemsize * int(dim)
                digests = b"".join([blake2b(raw[i : i + width], digest_size=16).digest() for i in range(0, len(raw), width)])
                h = np.frombuffer(digests, np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[some]),
                        pa.array(asks[some].astype(bool)),
                        _binary(coded, np.arange(1, len(some) + 1) * width),
                        pa.array(np.full(len(some), dim, np.int32)),
                        pa.array(np.einsum("ij,ij->i", own, own, dtype=np.float64)),
                        pa.array(h[:, 0].copy()),
                        pa.array(h[:, 1].copy()),
                    ],
                    names=["vec_id", "asks", "vector", "dim", "norm2", "h1", "h2"],
                )

    return plain.mapInArrow(rows, _ROWS_DDL)


def _longer(vectors: np.ndarray, norm2: float) -> np.ndarray:
    vectors = vectors.astype(np.float64)
    rest = np.sqrt(np.maximum(norm2 - np.einsum("ij,ij->i", vectors, vectors), 0))
    return np.hstack([vectors, rest[:, None]])


def _as_queries(vectors: np.ndarray, norm2: float) -> np.ndarray:
    """Queries have length as all others, and no added coordinate."""
    vectors = vectors.astype(np.float64)
    lengths = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return np.hstack([vectors * (np.sqrt(norm2) / lengths)[:, None], np.zeros((len(vectors), 1))])


def _moments(classes: DataFrame, form: _Form, norm2: float) -> tuple[np.ndarray, np.ndarray]:
    """Mean and standard deviation of each projected coordinate over all vectors."""

    def sums(batches: BatchesIn) -> Batches:
        wide, _ = _projections(form.dim)
        n, first, second = 0, np.zeros((ORDERINGS, DIMENSIONS)), np.zeros((ORDERINGS, DIMENSIONS))
        for batch in batches:
            if batch.num_rows:
                projected = _longer(form.vectors(batch), norm2) @ wide
                n += batch.num_rows
                first += projected.sum(axis=1)
                second += (projected**2).sum(axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(first.size)), pa.array([n] * first.size), pa.array(first.ravel()), pa.array(second.ravel())],
            names=["i", "n", "a", "b"],
        )

    rows = (
        classes.select("vector")
        .mapInArrow(sums, "i long, n long, a double, b double")
        .groupBy("i")
        .agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b"))
        .collect()
    )
    mean, spread = np.zeros(ORDERINGS * DIMENSIONS), np.ones(ORDERINGS * DIMENSIONS)
    for r in (r for r in rows if r["n"]):
        mean[r["i"]] = r["a"] / r["n"]
        spread[r["i"]] = np.sqrt(max(r["b"] / r["n"] - mean[r["i"]] ** 2, 0)) or 1.0
    return tuple(x.reshape(ORDERINGS, 1, DIMENSIONS) for x in (mean, spread))


def _mixed(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - TAIL_BITS)).astype(np.int64)


class _Curves:
    """Keys of vectors in each ordering."""

    def __init__(self, dim: int, norm2: float, mean: np.ndarray, spread: np.ndarray):
        self.dim, self.norm2, self.mean, self.spread = dim, norm2, mean, spread

    def keys(self, long_vectors: np.ndarray, ids: np.ndarray, orderings: int = ORDERINGS) -> np.ndarray:
        """One row for each of the first ``orderings``."""
        wide, shift = (x[:orderings] for x in _projections(self.dim))
        z = (long_vectors @ wide - self.mean[:orderings]) / self.spread[:orderings]
        # Three standard deviations to either side fill the grid, the shift moves it by up to a cell.
        cells = np.clip((z + 3) / 6 * ((1 << BITS) - 1) + shift, 0, (1 << BITS) - 1).astype(np.int64)
        return np.stack([hilbert(c, BITS) << TAIL_BITS | _mixed(ids) for c in cells])

    def own(self, vectors: np.ndarray, ids: np.ndarray, orderings: int = ORDERINGS) -> np.ndarray:
        return self.keys(_longer(vectors, self.norm2), ids, orderings)

    def asked(self, vectors: np.ndarray, ids: np.ndarray, orderings: int = ORDERINGS) -> np.ndarray:
        return self.keys(_as_queries(vectors, self.norm2), ids, orderings)


#: Queries and vectors that are multiplied at once, and pairs that are scored at once.
_QUERIES, _TILE, _PAIRS = 512, 512, 1 << 16


class _Held:
    """Vectors that queries are compared with: as they are, and in single precision of a size that cannot overflow."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        longest = np.sqrt(max((float(np.einsum("ij,ij->i", vectors[i : i + 4096], vectors[i : i + 4096], dtype=np.float64).max()) for i in range(0, len(ids), 4096)), default=0.0)) or 1.0
        if vectors.dtype == np.float32 and 1e-9 < longest < 1e9:
            self.light, self.longest = vectors, longest
        else:
            self.light, self.longest = (vectors / longest).astype(np.float32), 1.0


def _true(mask: np.ndarray, size: int) -> np.ndarray:
    """Where the first ``size`` of a mask that has 64 more are true, if few are: looks at 64 of them at once. Clears up to 64 behind them."""
    mask[size : size + 64] = False
    eights = mask[: -(-size // 64) * 64].view(np.uint64) != 0
    within = np.arange(8)
    some = (np.flatnonzero(eights.view(np.uint64))[:, None] * 8 + within).ravel()
    some = (some[eights[some]][:, None] * 8 + within).ravel()
    return some[mask[some]]


class _Best:
    """The best of the vectors that a few queries have met so far."""

    def __init__(self, queries: np.ndarray, held: _Held, k: int):
        self.queries, self.held, self.k = queries.astype(np.float64), held, k
        lengths = np.sqrt((self.queries**2).sum(axis=1))
        self.light = (self.queries / np.where(lengths > 0, lengths, 1)[:, None]).astype(np.float32)
        # What rounding may take from a product of single precision, and add to another one.
        self.margin = np.float32(2 * (queries.shape[1] + 8) * np.finfo(np.float32).eps * held.longest)
        self.least = np.full(len(queries), -np.inf, np.float32)
        self.parts, self.n, self.unbounded = [], 0, True
        self.room = 4 * k * len(queries)
        self.scores, self.mask = np.empty(len(queries) * _TILE, np.float32), np.empty(len(queries) * _TILE + 64, bool)

    def meet(self, low: int, high: int, begin: int, end: int) -> None:
        """Queries ``low`` to ``high`` meet vectors ``begin`` to ``end``."""
        for at in range(begin, end, _TILE):
            m = min(_TILE, end - at)
            size = (high - low) * m
            scores = np.matmul(self.light[low:high], self.held.light[at : at + m].T, out=self.scores[:size].reshape(-1, m))
            least = self.least[low:high]
            if self.unbounded and m >= self.k and np.isneginf(least).any():
                np.maximum(least, self._bound(scores, low, high, at + m, end) - self.margin, out=least)
                self.unbounded = bool(np.isneginf(self.least).any())
            np.greater_equal(scores, least[:, None], out=self.mask[:size].reshape(-1, m))
            pairs = _true(self.mask, size)
            if len(pairs):
                asking = pairs // m
                self.parts.append((asking + low, pairs - asking * m + at, self.scores[pairs]))
                self.n += len(pairs)
                if self.n > self.room:
                    self._cut()
                    if 2 * self.n > self.room:  # many within the margin
                        asking, near, _ = self._scored()
                        kept = (self.light[asking] * self.held.light[near]).sum(axis=1)
                        self.parts, self.n = [(asking, near, kept)], len(near)

    def _bound(self, scores: np.ndarray, low: int, high: int, at: int, end: int) -> np.ndarray:
        """What ``k`` of these scores reach, or of the greatest of groups of vectors, with those up to four tiles further."""
        group, n = 16, min(end - at, 4 * _TILE) // 16 * 16
        if n // group < 2 * self.k:
            return np.partition(scores, -self.k, axis=1)[:, -self.k]
        more = self.held.light[at : at + n] @ self.light[low:high].T
        greatest = more.reshape(n // group, group, -1).max(axis=1)
        return np.partition(greatest, -self.k, axis=0)[-self.k]

    def _cut(self) -> None:
        """Drop what ``k`` others exceed by more than rounding."""
        if not self.parts:
            self.parts = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32))]
        asking, near, scores = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        bits = (-scores + np.float32(0)).view(np.int32).astype(np.int64)
        rising = np.where(bits < 0, ~bits & 0x7FFFFFFF, bits | 0x80000000)
        order = np.argsort(asking << 32 | rising)
        asking, near, scores = asking[order], near[order], scores[order]
        ends = np.searchsorted(asking, np.arange(len(self.queries) + 1))
        full = np.flatnonzero(np.diff(ends) >= self.k)
        self.least[full] = np.maximum(self.least[full], scores[ends[full] + self.k - 1] - self.margin)
        kept = scores >= self.least[asking]
        self.parts, self.n = [(asking[kept], near[kept], scores[kept])], int(kept.sum())

    def _exact(self, asking: np.ndarray, near: np.ndarray) -> np.ndarray:
        """Scores, by sums in one order: a pair scores alike anywhere."""
        exact = np.empty(len(near))
        for low in range(0, len(near), _PAIRS):
            some = slice(low, low + _PAIRS)
            exact[some] = (self.queries[asking[some]] * self.held.vectors[near[some]]).sum(axis=1)
        return exact

    def _scored(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, vector and score of the ``k`` best, ties to the smaller id."""
        asking, near, _ = self.parts[0]
        exact = self._exact(asking, near)
        order = np.lexsort((self.held.ids[near], -exact, asking))
        asking = asking[order]
        kept = np.arange(len(asking)) - np.searchsorted(asking, asking) < self.k
        return asking[kept], near[order][kept], exact[order][kept]

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        self._cut()
        return self._scored()

    def among(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``found``, in any order for a query, and with as many again that rounding could not tell from them."""
        self._cut()
        if self.n > 2 * self.k * len(self.queries):
            return self._scored()
        asking, near, _ = self.parts[0]
        return asking, near, self._exact(asking, near)


def _best(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """For each query the indices and scores of the ``k`` best, ties to the smaller id.

    Products find them, sums in one order give the scores: the same pair scores alike in any block. All vectors
    that reach the last place's product, less what rounding may take, are scored, however many tie there.
    """
    wide = min(k, len(ids))
    if not len(queries) or not wide:
        return np.empty((len(queries), wide), np.int64), np.empty((len(queries), wide))
    best = _Best(queries, _Held(vectors, ids), wide)
    best.meet(0, len(queries), 0, len(ids))
    _, near, scores = best.found()
    return near.reshape(-1, wide), scores.reshape(-1, wide)


_HIT = np.dtype([("lack", np.float64), ("id", np.int64)])
_HITS_DDL = "class_id long, hits binary"


def _hit_rows(classes: np.ndarray, asking: np.ndarray, near_ids: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
    """A row for each of ``classes`` with hits; ``asking`` counts them, in order."""
    hits = np.empty(len(asking), _HIT)
    hits["lack"], hits["id"] = -scores, near_ids  # the negative score, so that plain ascending order is nearest first
    ends = np.searchsorted(asking, np.arange(len(classes)), side="right")
    some = np.diff(ends, prepend=0) > 0
    return pa.RecordBatch.from_arrays([pa.array(classes[some]), _binary(hits, ends[some] * _HIT.itemsize)], names=["class_id", "hits"])


def _merged(hits: DataFrame, k: int) -> DataFrame:
    """``(asking, lack, class_id)``: the ``k`` best of each class's hits, ties to smaller ids."""

    def best(asking: np.ndarray, hits: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((hits["id"], hits["lack"], asking))
        asking, hits = asking[order], hits[order]
        new = np.ones(len(asking), bool)  # a pair that met in several orderings counts once
        new[1:] = (asking[1:] != asking[:-1]) | (hits[1:] != hits[:-1])
        asking, hits = asking[new], hits[new]
        kept = np.arange(len(asking)) - np.searchsorted(asking, asking) < k
        columns = [asking[kept], hits["lack"][kept], hits["id"][kept]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["asking", "lack", "class_id"])

    def merge(batches: BatchesIn) -> Batches:
        asking, hits = np.empty(0, np.int64), np.empty(0, _HIT)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = _bytes(batch, "hits")
            asking = np.concatenate([asking, np.repeat(_numbers(batch, "class_id"), np.diff(offsets) // _HIT.itemsize)])
            hits = np.concatenate([hits, np.frombuffer(data, _HIT)])
            whole = np.searchsorted(asking, asking[-1])  # the last class may go on in the next batch
            if whole:
                yield best(asking[:whole], hits[:whole])
                asking, hits = asking[whole:], hits[whole:]
        if len(asking):
            yield best(asking, hits)

    return hits.repartition("class_id").sortWithinPartitions("class_id").mapInArrow(merge, "asking long, lack double, class_id long")


def exhaustive(classes: DataFrame, asked: DataFrame, form: _Form, k: int) -> DataFrame:
    """The true best ``k`` of a bounded set of queries: all vectors pass by in blocks."""
    rows = asked.select("class_id", "vector").collect()
    ids = np.array([r["class_id"] for r in rows], np.int64)
    queries = np.array([form.decoded(r["vector"]) for r in rows]).reshape(-1, form.dim)

    def search(batches: BatchesIn) -> Batches:
        for batch in batches:
            if batch.num_rows:
                own = _numbers(batch, "class_id")
                near, scores = _best(queries, form.vectors(batch), own, k)
                yield _hit_rows(ids, np.repeat(np.arange(len(ids)), near.shape[1]), own[near.ravel()], scores.ravel())

    return _merged(classes.select("class_id", "vector").mapInArrow(search, _HITS_DDL), k)


def _reach(classes: DataFrame, truth: DataFrame, curves: _Curves, form: _Form, cuts: np.ndarray) -> tuple[int, int]:
    """How many orderings are visited, and how many blocks to either side: what finds ``TARGET`` of the true neighbours, or all."""
    pairs = [(r["asking"], r["class_id"]) for r in truth.collect() if r["asking"] != r["class_id"]]  # PILOTS * k
    wanted = sorted({x for pair in pairs for x in pair})
    rows = classes.where(F.col("class_id").isin(wanted)).select("class_id", "vector").collect() if wanted else []
    if not rows:
        return 1, 0
    ids, vectors = np.array([r["class_id"] for r in rows], np.int64), np.array([form.decoded(r["vector"]) for r in rows])
    place = {i: n for n, i in enumerate(ids.tolist())}
    asking, near = np.array([[place[a], place[b]] for a, b in pairs]).T
    blocks = cuts.shape[1] + 1
    own, at = (
        np.stack([np.searchsorted(cuts[t], keys[t], side="right") for t in range(ORDERINGS)])
        for keys in (curves.own(vectors, ids), curves.asked(vectors, ids))
    )
    away = np.abs(at[:, asking] - own[:, near])
    least = np.sort(away.min(axis=0))
    radius = int(least[min(len(least) - 1, int(np.ceil(TARGET * len(least))) - 1)])
    seen = np.minimum(at[:, asking] + radius, blocks - 1) - np.maximum(at[:, asking] - radius, 0) + 1
    return (ORDERINGS, radius) if seen.sum() < blocks * len(asking) else (1, blocks - 1)


def _cuts(classes: DataFrame, curves: _Curves, form: _Form, rows: int) -> np.ndarray:
    """Block borders of each ordering: quantiles of its keys, from every sixteenth part of a block of each task's keys in order."""
    blocks = max(1, min(MAX_BLOCKS, -(-rows // BLOCK_ROWS)))
    if blocks == 1:
        return np.empty((ORDERINGS, 0), np.int64)
    step = max(1, rows // blocks // 16)

    def taken(keys: np.ndarray) -> pa.RecordBatch:
        keys = np.sort(keys, axis=1)
        some = np.ascontiguousarray(keys[:, min(step // 2, keys.shape[1] - 1) :: step])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.arange(ORDERINGS, dtype=np.int32)),
                pa.array(np.full(ORDERINGS, keys.shape[1] / some.shape[1])),
                _binary(some, np.arange(1, ORDERINGS + 1) * some.shape[1] * 8),
            ],
            names=["ordering", "weight", "keys"],
        )

    def runs(batches: BatchesIn) -> Batches:
        parts, n = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(curves.own(form.vectors(batch), _numbers(batch, "class_id")))
                n += batch.num_rows
            if n >= 1 << 17:
                yield taken(np.hstack(parts))
                parts, n = [], 0
        if n:
            yield taken(np.hstack(parts))

    found = classes.select("class_id", "vector").mapInArrow(runs, "ordering int, weight double, keys binary").collect()
    cuts = []
    for t in range(ORDERINGS):
        own = [(np.frombuffer(r["keys"], np.int64), r["weight"]) for r in found if r["ordering"] == t]
        keys, weights = np.concatenate([k for k, _ in own]), np.concatenate([np.full(len(k), w) for k, w in own])
        order = np.argsort(keys)
        passed = np.cumsum(weights[order])
        cuts.append(keys[order][np.searchsorted(passed, passed[-1] * np.arange(1, blocks) / blocks).clip(max=len(keys) - 1)])
    return np.array(cuts)


#: Bits of a block in a placed row's code, below one that marks queries; the span stands above.
_BLOCK_BITS = 32


def _windows(classes: DataFrame, curves: _Curves, form: _Form, rows: int, cuts: np.ndarray, orderings: int, radius: int, k: int) -> DataFrame:
    """``(class_id, hits)`` of each query and span that it visits."""
    blocks = cuts.shape[1] + 1
    spans = max(min(SPANS, blocks), -(-rows * form.dim * form.size // SPAN_BYTES))
    length = -(-blocks // spans)
    deal = _dealt(classes.sparkSession, orderings * spans)

    def place(batches: BatchesIn) -> Batches:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors, coded = _numbers(batch, "class_id"), form.vectors(batch), batch.column(batch.schema.get_field_index("vector"))
            asks = np.flatnonzero(_numbers(batch, "asks"))
            own = curves.own(vectors, ids, orderings)
            asked = curves.asked(vectors[asks], ids[asks], orderings) if len(asks) else own[:, :0]
            for t in range(orderings):
                block = np.searchsorted(cuts[t], own[t], side="right")
                yield _placed_rows(deal, t * spans + block // length, False, block, ids, coded)
                at = np.searchsorted(cuts[t], asked[t], side="right")
                first, last = np.maximum(at - radius, 0) // length, np.minimum(at + radius, blocks - 1) // length
                visits = last - first + 1
                each = np.repeat(np.arange(len(at)), visits)
                span = np.arange(len(each)) - np.repeat(np.cumsum(visits) - visits, visits) + first[each]
                for low in range(0, len(each), 10_000):
                    some = slice(low, low + 10_000)
                    rows = asks[each[some]]
                    yield _placed_rows(deal, t * spans + span[some], True, at[each[some]], ids[rows], coded.take(pa.array(rows)))

    def search(batches: BatchesIn) -> Batches:
        span, parts, held = None, [], None
        for batch in batches:
            codes, own, vectors = _numbers(batch, "code"), _numbers(batch, "class_id"), form.vectors(batch)
            block, owner = codes & (1 << _BLOCK_BITS) - 1, codes >> _BLOCK_BITS  # the span, and whether it is a query
            ends = np.flatnonzero(np.diff(owner)) + 1
            for low, high in zip([0, *ends], [*ends, len(own)], strict=True):
                if low == high:
                    continue
                if owner[low] >> 1 != span:
                    span, parts, held = owner[low] >> 1, [], None
                if not owner[low] & 1:
                    parts.append((vectors[low:high].copy(), own[low:high].copy(), block[low:high].copy()))
                    continue
                if held is None:
                    if not parts:
                        continue
                    held, tiles = _gathered(parts, form)
                for some in range(low, high, _QUERIES):
                    part = slice(some, min(some + _QUERIES, high))
                    best = _Best(vectors[part], held, k)
                    begins = np.searchsorted(block[part], tiles[:, 2] - radius)
                    stops = np.searchsorted(block[part], tiles[:, 2] + radius, side="right")
                    for (begin, end, _), of, to in zip(tiles.tolist(), begins.tolist(), stops.tolist(), strict=True):
                        if of < to:
                            best.meet(of, to, begin, end)
                    asking, near, scores = best.among()
                    yield _hit_rows(own[part], asking, held.ids[near], scores)

    placed = classes.select("class_id", "asks", "vector").mapInArrow(place, "deal int, code long, class_id long, vector binary")
    return placed.repartition(len(deal), "deal").sortWithinPartitions("code").mapInArrow(search, _HITS_DDL)


def _dealt(spark: SparkSession, n: int) -> np.ndarray:
    """Numbers that hash into ``n`` different partitions, as long as there are ``n``."""
    hashed = spark.range(20 * n + 100).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("p"), "id")
    least = dict(hashed.groupBy("p").agg(F.min("id")).collect())
    return np.array([least.get(p, p) for p in range(n)], np.int32)


def _placed_rows(deal: np.ndarray, span: np.ndarray, is_query: bool, block: np.ndarray, ids: np.ndarray, vectors: pa.Array) -> pa.RecordBatch:
    code = (span.astype(np.int64) << 1 | int(is_query)) << _BLOCK_BITS | block
    return pa.RecordBatch.from_arrays(
        [pa.array(deal[span]), pa.array(code), pa.array(ids), vectors], names=["deal", "code", "class_id", "vector"]
    )


def _gathered(parts: list, form: _Form) -> tuple[_Held, np.ndarray]:
    """A span's vectors, and begin, end and number of its blocks. Empties ``parts``, as there is no room for vectors twice."""
    n = sum(len(ids) for _, ids, _ in parts)
    vectors, ids, blocks = np.empty((n, form.dim), f"f{form.size}"), np.empty(n, np.int64), np.empty(n, np.int64)
    at = 0
    parts.reverse()
    while parts:
        some = parts.pop()
        to = at + len(some[1])
        vectors[at:to], ids[at:to], blocks[at:to] = some
        at = to
    begins = np.flatnonzero(np.diff(blocks, prepend=-1))
    return _Held(vectors, ids), np.stack([begins, [*begins[1:], n], blocks[begins]], axis=1)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each query row the ``k`` rows of largest inner product found.

    Candidates are all rows but those with the query's id; ranks start at 1 and ties go to the smaller id.
    Scores are inner products of the original vectors in double precision. Rows without an id, and vectors that are
    null, empty, zero, of another dimension than most, or that hold null or non-finite components take no
    part. Repeated rows count once, and an id with several vectors counts with the smallest one. Fewer candidates than ``k`` are all returned; an empty table or one without
    queries gives an empty result. Other columns are ignored.
    """
    kind = vectors.select(F.col(vector_col)).schema[0].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    plain = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
        F.col(vector_col).cast("array<float>" if single else "array<double>").alias("embedding"),
    ).where("vec_id is not null and embedding is not null")
    rows = written(_usable(plain), "vectors")
    most = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = most["dim"] if most else 1
    form = _Form(dim, 4 if single else 8)
    rows = rows.where(F.col("dim") == dim).drop("dim")

    # One row an id. Those of several rows, and classes of several ids, are written: joins go by their true size.
    several = written(rows.groupBy("vec_id").count().where("count > 1").select("vec_id"), "several")
    unique = rows if several.isEmpty() else written(_smallest(rows, several), "unique")
    copied = written(
        unique.groupBy("h1", "h2")
        .agg(F.min("vec_id").alias("class_id"), F.max("asks").alias("any_asks"), F.count("*").alias("n"))
        .where("n > 1"),
        "copied",
    )
    of_class = unique.join(copied, ["h1", "h2"], "left").withColumn("class_id", F.coalesce("class_id", "vec_id"))
    classes = of_class.where("vec_id = class_id").select("class_id", F.coalesce("any_asks", "asks").alias("asks"), "vector", "norm2")
    classes = classes if copied.isEmpty() else written(classes, "classes")  # they are read several times
    longest, n, asking = classes.agg(F.max("norm2"), F.count("*"), F.count_if("asks")).first()

    longest = (longest or 1.0) * (1 + 1e-12)
    curves = _Curves(dim, longest, *_moments(classes, form, longest))
    cuts = _cuts(classes, curves, form, n)
    wanted = k + 1  # a query finds itself
    pilots = classes.where("asks").orderBy(F.xxhash64("class_id"), "class_id").limit(PILOTS)
    orderings, radius = _reach(classes, exhaustive(classes, pilots, form, wanted), curves, form, cuts) if asking else (1, 0)
    found = _merged(_windows(classes, curves, form, n, cuts, orderings, radius, wanted), wanted)

    in_class = Window.partitionBy("class_id").orderBy("vec_id")
    members = (
        of_class.where("n is not null")
        .select("vec_id", "class_id")
        .withColumn("n", F.row_number().over(in_class))
        .where(F.col("n") <= wanted)
        .groupBy("class_id")
        .agg(F.collect_list("vec_id").alias("members"))
    )
    answers = (
        found.join(members, "class_id", "left")
        .select("asking", "lack", F.explode(F.coalesce("members", F.array("class_id"))).alias("id"))
        .groupBy("asking")
        .agg(F.collect_list(F.struct("lack", "id")).alias("hits"))
        .select(F.col("asking").alias("class_id"), F.slice(F.array_sort("hits"), 1, wanted).alias("hits"))
    )
    others = F.slice(F.filter("hits", lambda h: h["id"] != F.col("query_id")), 1, k)
    return (
        of_class.where("asks")
        .select(F.col("vec_id").alias("query_id"), "class_id")
        .join(answers, "class_id")
        .select("query_id", F.posexplode(others).alias("nth", "hit"))
        .select(
            "query_id",
            (F.col("nth") + 1).cast("int").alias("rank"),
            F.col("hit.id").alias("vec_id"),
            (-F.col("hit.lack")).alias("score"),
        )
    )
