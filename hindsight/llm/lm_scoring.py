"""Scores of texts by a causal self-attention model on subword ids, next to a unigram base.

1. One scan of the texts gives their subword ids, and word and subword counts of the training
   documents, summed up per batch before they are shuffled.
2. The ``TOKENS`` most frequent subwords get a place of their own in the model; the others share one,
   and are told apart by their counts. All counts are of all training documents.
3. The model is trained in rounds: each trainer continues from the common weights on its share of the
   round's training windows, and the weights are averaged. The windows are segments of ``SEGMENT`` tokens; all segments of
   every training text are dealt to the rounds, so the weights learn from each training token once.
4. Every text is scored whole. Words are looked up in a bounded table of the most frequent ones, and
   those it does not have by a join.
"""

from collections import Counter
from functools import cache
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import Batches, BatchesIn, column, list_array, sized, small, written
from .subwords import encoder, strings

#: Subwords with a place of their own; one more is for all others, one for the end of a text.
TOKENS = attention.START - 2
_RARE, _END = TOKENS, TOKENS + 1
ROUNDS = 3
RATE = 3e-2
#: Tokens in a training window, and about as many as a trainer takes in a round.
SEGMENT = 256
SHARE = 4_000_000
#: Rows that a trainer's weights come in.
WEIGHT_PARTS = 16
#: Words whose counts are sent to every task: 16 bytes each.
FREQUENT_WORDS = 1 << 20
#: Distinct words that a task counts before it passes them on: 16 bytes each.
HELD_WORDS = 1 << 20
_END_OF_TEXT = 0  # stands for the end in tables of word hashes


_BASE = 0x9E3779B97F4A7C15
_BYTES = 1 << 20


@cache
def _powers(n: int, base: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i below n, a power of two."""
    powers = np.ones(1, np.uint64)
    while len(powers) < n:
        powers = np.concatenate([powers, powers * np.uint64(pow(base, len(powers), 1 << 64))])
    return powers


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text, with A-Z in lower case, without making the words.

    A word is a span between white space and its hash a difference of prefix sums, shifted back to
    where words start. Never 0.
    """
    data = np.frombuffer(text.lower() + b" ", np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edges = np.concatenate([[0], edges])
    starts, ends = edges[::2], edges[1::2]
    n = max(_BYTES, 1 << (len(data) - 1).bit_length())
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(n, _BASE)[: len(data)], out=sums[1:])
    inverse = pow(_BASE, -1, 1 << 64)
    hashes = (sums[ends] - sums[starts]) * _powers(n, inverse)[starts]
    hashes = (hashes ^ (hashes >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(29)
    return np.maximum(hashes, np.uint64(1)).view(np.int64)


def _hashes_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts one after the other, and how many each has."""
    hashes, sizes, low = [], [], 0
    while low < len(texts):
        high, held = low, 0
        while high < len(texts) and (held + len(texts[high]) < _BYTES or high == low):
            held += len(texts[high]) + 1
            high += 1
        some = texts[low:high]
        found = word_hashes(b" ".join(some))
        each = [word_count(x) for x in some]
        hashes.append(found)
        sizes += each
        low = high
    return (np.concatenate(hashes) if hashes else np.empty(0, np.int64)), np.array(sizes, np.int64)


def hashes_of_words(found: list[bytes], size: int = 50_000) -> np.ndarray:
    """The hash of each of some words that are split already."""
    parts = [word_hashes(b" ".join(found[low : low + size])) for low in range(0, len(found), size)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def word_count(text: bytes) -> int:
    space = _SPACE[np.frombuffer(b" " + text, np.uint8)]
    return int(np.count_nonzero(space[:-1] & ~space[1:]))


def held_out(doc_id):
    """Documents not to learn from: crc32 of the id's text is 1 modulo 5. A null id has the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


_SCANNED_DDL = (
    "doc_id long, text_key long, held_out boolean, n_tokens long, ids binary, "
    "kind string, keys array<long>, counts array<long>"
)
_SCANNED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("text_key", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("ids", pa.binary()),
        ("kind", pa.string()),
        ("keys", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())),
    ]
)


def _scan(plain: DataFrame, tokenizer: str) -> DataFrame:
    """Rows of kind ``text`` with ids, and of kinds ``word`` and ``subword`` with counts, a few per batch."""

    def rows(batches: BatchesIn) -> Batches:
        own = encoder(tokenizer)
        # Counts grow over batches, so that what is shuffled is summed up, and go on before they fill the memory.
        held_words = _HeldCounts()
        subword_counts, learnt_texts = np.zeros(own.tokenizer.get_vocab_size(), np.int64), 0
        for batch in sized(batches):
            n = batch.num_rows
            split = own.split(batch.column(batch.schema.get_field_index("text")), lower=True)
            ids, sizes = own.ids_of_words(split), np.diff(split.offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.select(["doc_id", "text_key", "held_out"]).columns,
                    pa.array(sizes + 1, pa.int64()),
                    ids,
                    pa.array(["text"] * n),
                    pa.nulls(n, pa.list_(pa.int64())),
                    pa.nulls(n, pa.list_(pa.int64())),
                ],
                schema=_SCANNED,
            )
            learnt = ~np.array(column(batch, "held_out"), bool)
            learnt_texts += int(learnt.sum())
            times = np.bincount(split.numbers[np.repeat(learnt, sizes)], minlength=len(split.distinct))
            seen = np.flatnonzero(times)
            held_words.add(hashes_of_words(strings(split.distinct.take(pa.array(seen)))), times[seen])
            subword_counts += np.bincount(
                np.frombuffer(b"".join(strings(ids.filter(pa.array(learnt)))), own.dtype), minlength=len(subword_counts)
            )
            if held_words.full():
                yield from _count_rows("word", *held_words.taken())
        if learnt_texts:
            yield from _count_rows("word", *held_words.taken())
            yield from _count_rows("word", np.array([_END_OF_TEXT]), np.array([learnt_texts]))
            seen = np.flatnonzero(subword_counts)
            yield from _count_rows("subword", seen, subword_counts[seen])

    return written(plain.mapInArrow(rows, _SCANNED_DDL), "scanned")


class _HeldCounts:
    """Counts by word hash, summed up whenever they become more than ``HELD_WORDS``."""

    def __init__(self):
        self.keys, self.counts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        if sum(len(k) for k, _ in self.waiting) > HELD_WORDS:
            self._sum_up()

    def full(self) -> bool:
        return len(self.keys) > HELD_WORDS

    def taken(self) -> tuple[np.ndarray, np.ndarray]:
        self._sum_up()
        out = self.keys, self.counts
        self.__init__()
        return out

    def _sum_up(self) -> None:
        keys, counts = (np.concatenate(x) for x in zip((self.keys, self.counts), *self.waiting, strict=True))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
        self.keys = keys[first]
        self.counts = np.add.reduceat(counts[order], first) if len(first) else np.empty(0, np.int64)
        self.waiting = []


def _count_rows(kind: str, keys: np.ndarray, counts: np.ndarray, size: int = 50_000):
    for low in range(0, len(keys), size):
        some = slice(low, low + size)
        yield pa.RecordBatch.from_arrays(
            [
                *[pa.nulls(1, t) for t in _SCANNED.types[:5]],
                pa.array([kind]),
                list_array([0, len(keys[some])], pa.array(keys[some], pa.int64())),
                list_array([0, len(keys[some])], pa.array(counts[some].astype(np.int64))),
            ],
            schema=_SCANNED,
        )


def _totals(scanned: DataFrame, kind: str) -> DataFrame:
    pair = F.explode(F.arrays_zip("keys", "counts")).alias("pair")
    return (
        scanned.where(F.col("kind") == kind)
        .select(pair)
        .groupBy(F.col("pair.keys").alias("key"))
        .agg(F.sum("pair.counts").alias("n"))
    )


class Vocabulary:
    """Subword ids to places in the model, and what a rare one costs beyond its place."""

    def __init__(self, counts: np.ndarray, texts: int):
        self.counts = counts
        order = np.argsort(-counts, kind="stable")
        own = order[:TOKENS]
        self.place = np.full(len(counts), _RARE, np.int16)
        self.place[own] = np.arange(len(own))
        rare = np.ones(len(counts), bool)
        rare[own] = False
        mass = (counts + 0.5) * rare
        self.extra = np.where(rare, np.log(np.where(rare, mass, 1) / max(mass.sum(), 1e-9)), 0)
        self.frequencies = np.bincount(self.place, weights=counts, minlength=TOKENS + 2)
        self.frequencies[_END] = texts

    def runs(self, ids: np.ndarray) -> np.ndarray:
        """The whole text as one run: start, its tokens, end."""
        return np.concatenate([[attention.START], self.place[ids], [_END]])


def _windows_of(run: np.ndarray) -> list[np.ndarray]:
    """The text's segments, each opened by the token before."""
    return [run[low : low + SEGMENT + 1] for low in range(0, len(run) - 1, SEGMENT)]


_WEIGHTS_DDL = "part int, trainer int, n long, w binary"


def _weights_rows(flat: np.ndarray, n: int, trainer: int) -> pa.RecordBatch:
    """A trainer's weights in ``WEIGHT_PARTS`` rows, four bytes a weight."""
    parts = [part.tobytes() for part in np.array_split(flat, WEIGHT_PARTS)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(range(WEIGHT_PARTS), pa.int32()),
            pa.array([trainer] * WEIGHT_PARTS, pa.int32()),
            pa.array([n] * WEIGHT_PARTS, pa.int64()),
            pa.array(parts, pa.binary()),
        ],
        names=["part", "trainer", "n", "w"],
    )


def _average(trained: DataFrame) -> np.ndarray | None:
    """The trainers' weights, weighed by the tokens they learnt from. No task holds more than one trainer's."""

    def average(batches: BatchesIn) -> Batches:
        sums: dict[int, np.ndarray] = {}
        tokens: Counter = Counter()
        for batch in small(batches):
            for part, n, w in zip(*(column(batch, c) for c in ("part", "n", "w")), strict=True):
                sums[part] = sums.get(part, 0) + n * np.frombuffer(w, np.float32).astype(np.float64)
                tokens[part] += n
        if sums:
            flat = [(w / tokens[part]).astype(np.float32).tobytes() for part, w in sums.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(flat, pa.binary())], names=["part", "w"])

    parts = trained.repartition(WEIGHT_PARTS, "part").sortWithinPartitions("part", "trainer").mapInArrow(average, "part int, w binary")
    found = sorted((r["part"], bytes(r["w"])) for r in parts.collect())  # as many bytes as the model has
    return np.frombuffer(b"".join(w for _, w in found), np.float32) if found else None


def _train(texts: DataFrame, vocabulary: Vocabulary, tokens: int, dtype: str, seed: int) -> attention.Weights:
    """Rounds of training and averaging. ``texts`` are the training texts, ``tokens`` their number."""
    spark = texts.sparkSession
    weights = attention.initial(vocabulary.frequencies, seed)
    trainers = max(1, ceil(tokens / (ROUNDS * SHARE)))
    shared = spark.sparkContext.broadcast(vocabulary)

    def cut(batches: BatchesIn) -> Batches:
        for batch in small(batches, 2000):
            owners, places, runs = [], [], []
            for i, packed in enumerate(column(batch, "ids")):
                windows = _windows_of(shared.value.runs(np.frombuffer(packed, dtype)))
                owners += [i] * len(windows)
                places += range(len(windows))
                runs += [w.astype("<i2").tobytes() for w in windows]
            owned = batch.select(["doc_id", "text_key"]).take(pa.array(owners, pa.int64())).columns
            yield pa.RecordBatch.from_arrays(
                [*owned, pa.array(places, pa.int64()), pa.array(runs, pa.binary())], names=["doc_id", "text_key", "place", "run"]
            )

    place = ["doc_id", "text_key", "place"]
    windows = written(
        texts.select("doc_id", "text_key", "ids")
        .mapInArrow(cut, "doc_id long, text_key long, place long, run binary")
        .withColumn("round", F.pmod(F.xxhash64(*place, F.lit(seed)), F.lit(ROUNDS)).cast("int")),
        "windows",
    )
    for number in range(ROUNDS):
        now = spark.sparkContext.broadcast(weights)

        def learn(batches: BatchesIn, now=now, rate: float = RATE / 2**number, number: int = number) -> Batches:
            learnt, n, adam = now.value, 0, attention.Adam(now.value, rate)
            for batch in small(batches, 2000):
                runs = [np.frombuffer(r, "<i2").astype(np.int64) for r in column(batch, "run")]
                np.random.default_rng(number).shuffle(runs)
                learnt = attention.trained(learnt, *attention.stream(runs), adam=adam)
                n += sum(map(len, runs))
            if n:
                yield _weights_rows(learnt.flat().astype(np.float32), n, TaskContext.get().partitionId())

        trained = (
            windows.where(F.col("round") == number)
            .repartition(trainers, *place)
            .sortWithinPartitions(*place)
            .select("run")
            .mapInArrow(learn, _WEIGHTS_DDL)
        )
        flat = _average(trained)
        if flat is not None:
            weights = weights.like(flat)
    return weights


def _scored(texts: DataFrame, vocabulary: Vocabulary, weights: attention.Weights, dtype: str) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast((vocabulary, weights))
    names = ["doc_id", "text_key", "held_out", "n_tokens"]

    def score(batches: BatchesIn) -> Batches:
        vocabulary, weights = shared.value
        for batch in small(batches, 2000):
            ids = [np.frombuffer(x, dtype) for x in column(batch, "ids")]
            scores = [float(vocabulary.extra[x].sum()) for x in ids]
            low = 0
            while low < len(ids):  # as many texts at a time as make some thousand windows
                high, held = low, 0
                while high < len(ids) and (held < 1 << 18 or high == low):
                    held += len(ids[high]) + 1
                    high += 1
                runs = [vocabulary.runs(x) for x in ids[low:high]]
                found = attention.log_probabilities(weights, *attention.stream(runs))
                begins = np.cumsum([0, *[len(r) - 1 for r in runs[:-1]]])
                for i, part in enumerate(np.add.reduceat(found.astype(np.float64), begins), low):
                    scores[i] = (scores[i] + float(part)) / log(10)
                low = high
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, pa.array(scores, pa.float64())], names=[*names, "score"])

    return texts.select(*names, "ids").mapInArrow(
        score, "doc_id long, text_key long, held_out boolean, n_tokens long, score double"
    )


def _base(plain: DataFrame, counts: DataFrame, total: int, distinct: int) -> DataFrame:
    """``(doc_id, text_key, n_known, base_score)``, once for each id and text."""
    spark = plain.sparkSession
    # The least count such that no more words than fit have it; counts by size are few.
    sizes = counts.groupBy("n").agg(F.count("*").alias("words"))
    by_log = sizes.groupBy(F.floor(F.log2("n") * 8).alias("size")).agg(F.sum("words").alias("words"), F.min("n").alias("n"))
    least, room = None, FREQUENT_WORDS
    for r in by_log.orderBy(F.desc("size")).collect():
        room -= r["words"]
        if room < 0:
            break
        least = r["n"]
    frequent = (counts.where(F.col("n") >= least) if least else counts.where(F.lit(False))).toArrow()
    order = np.argsort(frequent.column("key").to_numpy())
    shared = spark.sparkContext.broadcast(
        tuple(frequent.column(c).to_numpy()[order] for c in ("key", "n"))
    )
    scale = np.log10(total + 0.5 * (distinct + 1))

    def look_up(batches: BatchesIn) -> Batches:
        keys, numbers = shared.value
        for batch in small(batches, 2000):
            texts = [text.encode("utf-8", "replace") for text in column(batch, "text")]
            hashes, sizes = _hashes_of(texts)
            own, inverse = np.unique(hashes, return_inverse=True)
            at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
            hit = keys[at] == own if len(keys) else np.zeros(len(own), bool)
            value = np.zeros(len(own))
            value[hit] = np.log10(numbers[at[hit]] + 0.5)
            owner = np.repeat(np.arange(len(texts)), sizes)
            sums = np.bincount(owner, weights=value[inverse], minlength=len(texts))
            missing = ~hit[inverse]
            known = sizes - np.bincount(owner[missing], minlength=len(texts))
            # The words that are not in the table, counted by text.
            pairs, times = np.unique(owner[missing] * len(own) + inverse[missing], return_counts=True)
            of_text, word = np.divmod(pairs, max(1, len(own)))
            ends = np.concatenate([[0], np.cumsum(np.bincount(of_text, minlength=len(texts)))])
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.select(["doc_id", "text_key"]).columns,
                    pa.array(sizes),
                    pa.array(known),
                    pa.array(sums),
                    list_array(ends, pa.array(own[word])),
                    list_array(ends, pa.array(times)),
                ],
                names=["doc_id", "text_key", "n_words", "known", "sum", "keys", "times"],
            )

    found = written(
        plain.select("doc_id", "text_key", "text").mapInArrow(
            look_up, "doc_id long, text_key long, n_words long, known long, sum double, keys array<long>, times array<long>"
        ),
        "words",
    )
    # Rows equal in id and text have equal results; one will do.
    found = found.dropDuplicates(["doc_id", "text_key"])
    rare = found.select(
        F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"), F.explode(F.arrays_zip("keys", "times")).alias("w")
    ).select("of_doc", "of_text", F.col("w.keys").alias("key"), F.col("w.times").alias("times"))
    infrequent = counts.where(F.col("n") < least) if least else counts
    seen = F.coalesce("n", F.lit(0))
    rare_sums = (
        rare.join(infrequent, "key", "left")
        .groupBy("of_doc", "of_text")
        .agg(
            F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * F.log10(seen + 0.5)).alias("more"),
        )
    )
    same = F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_text"))
    end = counts.where(F.col("key") == _END_OF_TEXT).first()
    end_count = end["n"] if end else 0
    zero = F.lit(0)
    return found.join(rare_sums, same, "left").select(
        "doc_id",
        "text_key",
        (F.col("known") + F.coalesce("more_known", zero) + int(end_count > 0)).alias("n_known"),
        (
            F.col("sum")
            + F.coalesce("more", F.lit(0.0))
            + float(np.log10(end_count + 0.5))
            - (F.col("n_words") + 1) * float(scale)
        ).alias("base_score"),
    )


def score_texts(documents: DataFrame, tokenizer: str, seed: int = 0) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` per row of ``documents``.

    Tokens are words and one end per text. The base is a unigram model of them with half a count added,
    ``score`` the log10 probability of the text's subwords and its end under the attention model; both
    learn from all documents that are not held out. A null text is an empty one, a null id counts as the empty
    string. Repeated rows each get their row and count as often. Without training documents all counts are
    0 and the model stays as it begins. An empty table gives an empty result; other columns are ignored.
    """
    plain = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        held_out(F.col("doc_id")).alias("held_out"),
    ).withColumn("text_key", F.xxhash64("text"))
    scanned = _scan(plain, tokenizer)
    counts = written(_totals(scanned, "word"), "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    own = encoder(tokenizer)
    subwords = np.zeros(own.tokenizer.get_vocab_size(), np.int64)
    for r in _totals(scanned, "subword").collect():  # at most the vocabulary
        subwords[r["key"]] = r["n"]
    texts = scanned.where("kind = 'text'")
    learnt = texts.where("not held_out")
    vocabulary = Vocabulary(subwords, learnt.count())
    tokens = int(subwords.sum())
    weights = _train(learnt, vocabulary, tokens, own.dtype.str, seed)

    scores = _scored(texts, vocabulary, weights, own.dtype.str)
    base = _base(plain, counts, total, distinct)
    same = scores["doc_id"].eqNullSafe(base["doc_id"]) & (scores["text_key"] == base["text_key"])
    return scores.join(base, same).select(
        scores["doc_id"].alias("doc_id"),
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )
