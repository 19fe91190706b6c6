"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

A document has a severity grade 0, 1, ..., K. The model says ``P(grade > k) = logistic(w.x - c_k)`` with
one weight vector for all thresholds ``c_0 < c_1 < ...`` (proportional odds), so evidence for any
grade informs all of them, and the expected severity is the sum of these probabilities.

``x`` are words and word pairs, hashed, each counted as ``1 + log(count)``. Training uses the
``MAX_LABELLED`` labelled documents that come first in a seeded order, their whole texts: documents
and grades are summed up by feature in the tasks, and of the documents' features the driver gets
only those whose presence goes with the grade beyond chance. A penalty keeps weights small.
Scoring covers every document and its whole text, with a table of the weights that are left.
"""

from collections.abc import Iterable
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, BatchesIn, column, list_array, small, words, written

#: Labelled documents that the model is fitted on, at most. The driver holds their significant features.
MAX_LABELLED = 6_000
HASH_BITS = 22
#: A feature stays if it is in so many training documents (near-copies count once), whatever share of
#: them that is, and deviates by so many standard errors.
LEAST_DOCUMENTS = 8
SIGNIFICANT = 6.0
#: Features of documents that a task holds before it sums them up.
HELD_FEATURES = 1_000_000
#: Occurrences of toxic words from which on a document labelled toxic is of grade 2 and 3.
GRADE_HITS = (3, 6)
#: Expected severity from which a document is rejected.
REJECT = 0.5

_STRIP = bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of the whole text, and their counts. Punctuation around words goes."""
    found = [w for w in (word.strip(_STRIP) for word in words(text)) if w]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    single = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    pairs = single[:-1] * np.uint64(0x9E3779B97F4A7C15) + single[1:]
    both = np.concatenate([single, pairs ^ (pairs >> np.uint64(31))])
    return np.unique((both >> np.uint64(64 - HASH_BITS)).astype(np.int64), return_counts=True)


class OrdinalModel(NamedTuple):
    """Weights of the features that count, by sorted feature, and the thresholds."""

    feature: np.ndarray
    weight: np.ndarray
    thresholds: np.ndarray

    def score(self, text: str | None) -> float:
        index, count = features(text)
        at = np.searchsorted(self.feature, index)
        hit = at < len(self.feature)
        hit[hit] = self.feature[at[hit]] == index[hit]
        return float(np.dot(self.weight[at[hit]], 1 + np.log(count[hit]))) if hit.any() else 0.0


def exceed(score, thresholds: np.ndarray) -> np.ndarray:
    """``P(grade > k)`` by row and threshold."""
    return 1 / (1 + np.exp(np.clip(thresholds - np.asarray(score)[..., None], -40, 40)))


class Examples(NamedTuple):
    """Features of training documents, one after the other: document, feature and count of each."""

    document: np.ndarray
    feature: np.ndarray
    count: np.ndarray
    grades: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]], grades: Iterable[int]) -> "Examples":
        sizes = [len(f) for f, _ in rows]
        both = [np.concatenate([r[k] for r in rows]) if rows else np.empty(0, np.int32) for k in range(2)]
        return cls(np.repeat(np.arange(len(rows), dtype=np.int32), sizes), *both, np.asarray(list(grades), np.int64))


@cache
def _mixers(bands: int, rows: int) -> np.ndarray:
    random = np.random.default_rng(3)
    return np.array([random.integers(0, 2**32, (rows, 2), dtype=np.uint32) for _ in range(bands)])


def band_keys(feature: np.ndarray, bands: int = 12, rows: int = 8) -> np.ndarray:
    """A key by band of min-hashes of one document's features; none without features."""
    if not len(feature):
        return np.empty(0, np.int64)
    least = np.empty((bands, rows), np.uint64)
    for band, row in np.ndindex(bands, rows):
        a, b = _mixers(bands, rows)[band, row]
        mixed = feature.astype(np.uint32) * (a | np.uint32(1)) + b
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(13)
        least[band, row] = mixed.min()
    key = np.zeros(bands, np.uint64)
    for row in range(rows):
        key = key * np.uint64(0x9E3779B97F4A7C15) + least[:, row]
    return key.view(np.int64)


def first_of_copies(keys: np.ndarray) -> np.ndarray:
    """Marks one document of each group of near-copies, or the words of a much copied text would seem to be
    signs of its grade. Copies agree in a band; ``keys`` has a row for each document."""
    group = np.arange(len(keys))
    for key in keys.T:
        _, first, member = np.unique(key, return_index=True, return_inverse=True)
        group = np.minimum(group, group[first][member])
    return group == np.arange(len(keys))


def significant(n: np.ndarray, total: np.ndarray, grades: np.ndarray) -> np.ndarray:
    """Whether the mean grade of the ``n`` documents with a feature, ``total / n``, differs significantly from all's."""
    spread = grades.std() if len(grades) else 0
    if not spread:
        return np.zeros(len(n), bool)
    z = (total - n * grades.mean()) / (spread * np.sqrt(np.maximum(n, 1)))
    return (n >= LEAST_DOCUMENTS) & (np.abs(z) >= SIGNIFICANT)


def select_features(data: Examples) -> np.ndarray:
    """Features whose documents' mean grade differs significantly from that of all."""
    n = np.bincount(data.feature, minlength=1 << HASH_BITS)
    total = np.bincount(data.feature, weights=data.grades[data.document], minlength=1 << HASH_BITS)
    return np.flatnonzero(significant(n, total, data.grades))


def graded_by_hits(data: Examples, hits: tuple[int, ...] = GRADE_HITS) -> Examples:
    """Grades for examples that are only told apart as harmless (0) and toxic (1).

    A toxic document's grade grows with the occurrences of words that go with toxic ones beyond chance.
    """
    toxic = (data.grades > 0).astype(np.int64)
    kept = select_features(data._replace(grades=toxic))
    n = np.bincount(data.feature, minlength=1 << HASH_BITS)
    share = np.bincount(data.feature, weights=toxic[data.document], minlength=1 << HASH_BITS) / np.maximum(n, 1)
    signs = np.zeros(1 << HASH_BITS, bool)
    signs[kept[share[kept] > 0.5]] = True
    found = np.bincount(data.document, weights=signs[data.feature] * data.count, minlength=len(toxic))
    return data._replace(grades=toxic * (1 + np.searchsorted(hits, found, side="right")))


def fit(data: Examples, penalty: float = 1e-3, steps: int = 400) -> OrdinalModel:
    """Penalised maximum likelihood by Adam on all examples at once.

    Without examples, or with one grade only, there are no weights and the thresholds are those of
    the grades' frequencies, which start from few grades above 0.
    """
    grades = data.grades
    top = int(grades.max(initial=0))
    frequent = np.array([(np.sum(grades > k) + 0.5) / (len(grades) + 10) for k in range(max(1, top))])
    thresholds = np.maximum.accumulate(np.log((1 - frequent) / frequent) + 1e-6 * np.arange(len(frequent)))
    kept = select_features(data)
    if not len(kept):
        return OrdinalModel(kept, np.empty(0, np.float32), thresholds)

    place = np.full(1 << HASH_BITS, -1)
    place[kept] = np.arange(len(kept))
    used = place[data.feature] >= 0
    owner, feature, value = data.document[used], place[data.feature[used]], 1 + np.log(data.count[used])
    n = len(grades)
    weight = np.zeros(len(kept))
    # Thresholds as the first and the logarithms of the steps, so that they stay in order.
    free = np.concatenate([thresholds[:1], np.log(np.maximum(np.diff(thresholds), 1e-3))])
    mean, square = np.zeros(len(kept) + len(free)), np.zeros(len(kept) + len(free))
    at = np.arange(n)
    for step in range(1, steps + 1):
        cuts = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        score = np.bincount(owner, weights=weight[feature] * value, minlength=n)
        above = np.hstack([np.ones((n, 1)), exceed(score, cuts), np.zeros((n, 1))])
        chance = np.maximum(above[at, grades] - above[at, grades + 1], 1e-12)
        slope = above * (1 - above)
        d_score = -(slope[at, grades] - slope[at, grades + 1]) / chance / n
        d_cut = np.zeros_like(above)
        np.add.at(d_cut, (at, grades), slope[at, grades] / chance / n)
        np.add.at(d_cut, (at, grades + 1), -slope[at, grades + 1] / chance / n)
        d_cuts = d_cut[:, 1:-1].sum(axis=0)
        d_free = np.array([d_cuts[i:].sum() * (np.exp(free[i]) if i else 1) for i in range(len(free))])
        d_weight = np.bincount(feature, weights=d_score[owner] * value, minlength=len(kept)) + penalty * weight
        gradient = np.concatenate([d_weight, d_free])
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        move = 0.05 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        weight, free = weight - move[: len(kept)], free - move[len(kept) :]
    return OrdinalModel(kept, weight.astype(np.float32), np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])))


def _keyed(batches: BatchesIn) -> Batches:
    for batch in small(batches):
        found = [band_keys(features(text)[0]) for text in column(batch, "text")]
        keys = list_array(np.cumsum([0, *map(len, found)]), pa.array(np.concatenate([np.empty(0, np.int64), *found])))
        yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, "keys"])


class _Labelled(NamedTuple):
    """Training documents in the shared folder; rows (sorted) and grades of those that count."""

    texts: DataFrame
    rows: np.ndarray
    grades: np.ndarray

    def _featurized(self, batches: BatchesIn):
        for batch in small(batches):
            for row, text in zip(column(batch, "row"), column(batch, "text"), strict=True):
                at = np.searchsorted(self.rows, row)
                if at < len(self.rows) and self.rows[at] == row:
                    yield at, *features(text)

    def selected(self) -> np.ndarray:
        """``select_features`` of whole texts: each task sums up by feature, and the driver gets the sums."""
        grades, featurized = self.grades, self._replace(texts=None)._featurized

        def sums(batches: BatchesIn) -> Batches:
            def summed(parts: list) -> tuple:
                feature, n, total = (np.concatenate(x) for x in zip(*parts, strict=True))
                feature, own = np.unique(feature, return_inverse=True)
                # Whole numbers far below 2 ** 53.
                return feature, *(np.bincount(own, weights=x).astype(np.int64) for x in (n, total))

            parts, held = [], 0
            for at, index, _ in featurized(batches):
                parts.append((index, np.ones(len(index), np.int64), np.full(len(index), grades[at], np.int64)))
                held += len(index)
                if held > HELD_FEATURES:
                    parts = [summed(parts)]
                    held = 0
            if parts:
                feature, n, total = summed(parts)
                for low in range(0, len(feature), 1 << 16):
                    some = slice(low, low + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x[some], pa.int64()) for x in (feature, n, total)], names=["feature", "n", "total"]
                    )

        # Of 2**HASH_BITS features at most.
        found = (
            self.texts.select("row", "text")
            .mapInArrow(sums, "feature long, n long, total long")
            .groupBy("feature")
            .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
            .where(F.col("n") >= LEAST_DOCUMENTS)
            .toArrow()
        )
        feature, n, total = (found.column(c).to_numpy() for c in ("feature", "n", "total"))
        return np.sort(feature[significant(n, total, grades)])

    def examples(self, kept: np.ndarray) -> Examples:
        """The documents with those of their features that are in ``kept``, and whole counts."""
        featurized = self._replace(texts=None)._featurized

        def some(batches: BatchesIn) -> Batches:
            for batch in small(batches):
                rows = []
                for at, index, count in featurized([batch]):
                    own = np.isin(index, kept, assume_unique=True)
                    rows.append((np.full(own.sum(), at), index[own], count[own]))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(x), pa.int32()) for x in zip(*rows, strict=True)],
                        names=["document", "feature", "n"],
                    )

        if not len(kept):
            return Examples.of([], [])._replace(grades=self.grades)
        found = self.texts.select("row", "text").mapInArrow(some, "document int, feature int, n int").toArrow()
        return Examples(*(found.column(c).to_numpy() for c in ("document", "feature", "n")), self.grades)


def train(
    documents: DataFrame, grades: DataFrame, by_hits: bool = False, max_labelled: int = MAX_LABELLED, seed: int = 0
) -> OrdinalModel:
    """Fit on at most ``max_labelled`` rows of ``grades`` (``doc_id``, ``grade`` from 0), each with its document.

    Null ids and grades are left out; an id with several grades counts with its highest. ``by_hits``:
    the grades are only 0 and 1, and severity is told from the texts (``graded_by_hits``).
    """
    usable = grades.where("doc_id is not null and grade is not null")
    chosen = (
        usable.groupBy("doc_id")
        .agg(F.max("grade").cast("long").alias("grade"))
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
        .limit(max_labelled)
    )
    texts = written(
        documents.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")  # at most max_labelled rows of two numbers
        .select(F.monotonically_increasing_id().alias("row"), "grade", "text")
        .mapInArrow(_keyed, "row long, grade long, text string, keys array<long>"),
        "labelled",
    )
    rows = texts.select("row", "grade", "keys").orderBy("row").toArrow()
    keys = rows.column("keys").combine_chunks()
    filled = np.diff(keys.offsets.to_numpy()) > 0
    kept = np.ones(rows.num_rows, bool)
    if filled.any():
        kept[filled] = first_of_copies(keys.flatten().to_numpy().reshape(filled.sum(), -1))
    labelled = _Labelled(texts, rows.column("row").to_numpy()[kept], rows.column("grade").to_numpy()[kept])
    if by_hits:
        labelled = labelled._replace(grades=graded_by_hits(labelled.examples(labelled.selected())).grades)
    return fit(labelled.examples(labelled.selected()))


def scored(documents: DataFrame, model: OrdinalModel) -> DataFrame:
    """``documents`` with ``severity`` (expected grade), ``grade`` (most probable) and ``toxic``.

    Existing columns of these names give way. A null or empty text has no features: its severity is
    what the thresholds alone say, well below rejection wherever most documents are harmless.
    """
    plain = documents.drop("severity", "grade", "toxic")
    schema = T.StructType([*plain.schema.fields])
    schema.add("severity", T.DoubleType()).add("grade", T.IntegerType()).add("toxic", T.BooleanType())

    def score(batches: BatchesIn) -> Batches:
        for batch in small(batches):
            sums = [model.score(text) for text in column(batch, "text")]
            above = exceed(np.array(sums, float), model.thresholds)
            chances = np.hstack([np.ones((len(sums), 1)), above]) - np.hstack([above, np.zeros((len(sums), 1))])
            severity = above.sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(severity),
                    pa.array(chances.argmax(axis=1).astype(np.int32)),
                    pa.array(severity >= REJECT),
                ],
                names=[*batch.schema.names, "severity", "grade", "toxic"],
            )

    return plain.mapInArrow(score, schema)


def _labelled(labels: DataFrame) -> DataFrame:
    return labels.select("doc_id", F.col("toxic").cast("int").alias("grade"))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id, severity, grade, toxic)`` for each row of ``documents``.

    Repeated rows are graded alike, null ids are graded too. Without labels nothing is toxic; an
    empty table gives an empty result; other columns are ignored.
    """
    model = train(documents, _labelled(labels), by_hits=True)
    return scored(documents.select("doc_id", "text"), model).select("doc_id", "severity", "grade", "toxic")


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose expected severity is below ``REJECT``, all columns as they are."""
    model = train(documents, _labelled(labels), by_hits=True)

    def keep(batches: BatchesIn) -> Batches:
        for batch in small(batches):
            sums = np.array([model.score(text) for text in column(batch, "text")], float)
            yield batch.filter(pa.array(exceed(sums, model.thresholds).sum(axis=1) < REJECT))

    return documents.mapInArrow(keep, documents.schema)
