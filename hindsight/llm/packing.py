"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Every source has a queue of its documents in a seeded order. A round-robin scheduler fills windows
of 16 sequences, or as many as there are sources if these are more: with each window a source earns its share of the target mixture and spends it
in whole tokens; what is left below a token is its deficit, carried to the next window. A source
whose queue is empty drops out and the others share by their weights.

What a source has been served before window k is therefore a function of k alone, with no loop over
windows: the whole tokens of its target share up to k, at most its queue. ``Schedule`` has that function.
Any task can start at any window with the right deficits, so the only state that has to be carried
across partitions is each document's place in its queue, a prefix sum over blocks of documents.

Windows follow each other gaplessly and sequences are cut every ``SEQUENCE`` tokens, so all
sequences are full but the last.
"""

from collections.abc import Mapping, Sequence
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, BatchesIn, column, sized, small, written
from .subwords import encoder

SEQUENCE = 4096
#: Sequences in a window, at least; with more sources a window has one for each, so that turns stay long.
TURNS = 16
#: Rows of a source's queue that one task sums up.
BLOCK_ROWS = 20_000
#: Pieces in a batch of results, of at most a sequence each.
PIECES = 2000
#: Sources whose totals the scheduler may hold: 24 bytes each, and a few vectors of that length.
MAX_SOURCES = 100_000


class Schedule:
    """Service of each source as a function of the window.

    ``totals`` are the queues' tokens, ``weights`` their shares. In virtual time v source s has
    earned ``weights[s] * v`` tokens and is empty at ``totals[s] / weights[s]``, so all service up to
    v is piecewise linear in v with a bend where a source runs out.
    """

    def __init__(self, totals, weights, window: int | None = None):
        self.totals = np.asarray(totals, np.int64)
        self.weights = np.asarray(weights, np.float64)
        self.window = window or SEQUENCE * max(TURNS, len(self.totals))
        self.all = int(self.totals.sum())
        self.windows = -(-self.all // self.window)
        empty = self.totals / self.weights
        order = np.argsort(empty, kind="stable")
        rate = self.weights.sum() - np.concatenate([[0], np.cumsum(self.weights[order])[:-1]])
        times = np.concatenate([[0], empty[order]])
        self._times = times
        self._served = np.concatenate([[0], np.cumsum(np.diff(times) * rate)])

    def time(self, k) -> np.ndarray:
        return np.interp(np.asarray(k, np.float64) * self.window, self._served, self._times)

    def served(self, source, k) -> np.ndarray:
        """Tokens of ``source`` served before window ``k``. Never falls with k."""
        total = self.totals[source]
        earned = np.floor(self.weights[source] * self.time(k) + 1e-9).astype(np.int64)
        return np.where(np.asarray(k) >= self.windows, total, np.clip(earned, 0, total))

    def window_of(self, source, place) -> np.ndarray:
        """The window that serves the token at ``place`` of the source's queue."""
        place = np.asarray(place, np.int64)
        guess = np.interp(place / self.weights[source], self._times, self._served) // self.window
        k = np.clip(guess.astype(np.int64), 0, self.windows - 1)
        while (late := self.served(source, k) > place).any():  # rounding can be a window off
            k = k - late
        while (early := self.served(source, k + 1) <= place).any():
            k = k + early
        return k

    def base(self, source, k) -> np.ndarray:
        """Where the source's part of window ``k`` starts: after all earlier windows, and after the
        sources whose turn is before its own. The first turn goes round."""
        sources = len(self.totals)
        every = np.arange(sources)[:, None]
        windows, which = np.unique(k, return_inverse=True)
        by_window = np.argsort(which, kind="stable")
        out = np.empty(len(k), np.int64)
        # A table per window, of the tokens of all sources up to each, serves all pieces in that window.
        step = max(1, (1 << 20) // sources)
        for low in range(0, len(windows), step):
            some = windows[low : low + step]
            before = self.served(every, some)
            upto = np.zeros((sources + 1, len(some)), np.int64)
            np.cumsum(self.served(every, some + 1) - before, axis=0, out=upto[1:])
            first, end = np.searchsorted(which[by_window], [low, low + len(some)])
            rows = by_window[first:end]
            at, own = which[rows] - low, source[rows]
            turn = some[at] % sources
            earlier = upto[own, at] - upto[turn, at] + np.where(own < turn, upto[-1, at], 0)
            out[rows] = before.sum(axis=0)[at] + earlier
        return out

    def pieces(self, source, start, length) -> tuple[np.ndarray, ...]:
        """``(run, offset in the run, length, position)`` of each piece of some runs of the queues."""
        source, start, length = (np.asarray(x, np.int64) for x in (source, start, length))
        first, last = self.window_of(source, start), self.window_of(source, start + length - 1)
        run, nth = _numbered(last - first + 1)
        k, own = first[run] + nth, source[run]
        begin, end = self.served(own, k), self.served(own, k + 1)
        here, until = np.maximum(start[run], begin), np.minimum(start[run] + length[run], end)
        position = self.base(own, k) + here - begin
        # The part of each window, cut again where sequences end.
        part, nth = _numbered(np.where(until > here, (position + until - here - 1) // SEQUENCE - position // SEQUENCE + 1, 0))
        cuts = (position[part] // SEQUENCE + nth) * SEQUENCE
        low = np.maximum(position[part], cuts)
        high = np.minimum(position[part] + (until - here)[part], cuts + SEQUENCE)
        offset = (here - start[run])[part] + low - position[part]
        return run[part], offset, high - low, low


def _numbered(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as its count says, and the number of the repeat."""
    index = np.repeat(np.arange(len(counts)), counts)
    return index, np.arange(len(index)) - np.repeat(np.cumsum(counts) - counts, counts)


def tokenized(documents: DataFrame, path: str, end_id: int, source: Column, by_word: bool = True) -> DataFrame:
    """``(row, doc_id, source, n, ids)`` in the shared folder; ids as packed integers, ended by ``end_id``.

    ``row`` tells rows apart that are equal in every column.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("n", pa.int64()), ("ids", pa.binary())])

    def encode(batches: BatchesIn) -> Batches:
        own = encoder(path, by_word)
        end = np.array([end_id], own.dtype).tobytes()
        for batch in sized(batches):
            ids = own.ids_of(batch.column(batch.schema.get_field_index("text")))
            ids = pc.binary_join_element_wise(ids, pa.scalar(end, pa.binary()), b"")
            sizes = pc.binary_length(ids).to_numpy() // own.dtype.itemsize
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["doc_id", "source"]).columns, pa.array(sizes, pa.int64()), ids], schema=schema
            )

    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), source.cast("string").alias("source"), "text")
    rows = plain.mapInArrow(encode, "doc_id long, source string, n long, ids binary")
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "tokens")


def queue_places(rows: DataFrame, seed: int = 0) -> DataFrame:
    """``(row, source, start)``: the tokens ahead of each row in its source's queue.

    The order within a queue is a seeded hash. A queue is cut into blocks by that hash; blocks are
    summed up first and rows only within their block, so no task gets a whole source.
    """
    blocks = max(1, ceil(rows.count() / BLOCK_ROWS))
    key = F.xxhash64(F.lit(seed), "doc_id", "row")
    keyed = rows.select("row", "source", "n", key.alias("key"), F.pmod(key, F.lit(blocks)).alias("block"))
    sums = keyed.groupBy("source", "block").agg(F.sum("n").alias("block_n"))
    by_block = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("source", "block", F.coalesce(F.sum("block_n").over(by_block), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "block").orderBy("key", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("within", F.coalesce(F.sum("n").over(within), F.lit(0)))
    same = placed["source"].eqNullSafe(ahead["source"]) & (placed["block"] == ahead["block"])
    return placed.join(ahead, same).select(
        "row", placed["source"].alias("source"), (F.col("ahead") + F.col("within")).alias("start")
    )


_PIECES_DDL = (
    "doc_id long, source string, start long, length long, doc_tokens long, sequence_id long, offset long, "
    "window long, ids binary"
)
_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("source", pa.string()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("window", pa.int64()),
        ("ids", pa.binary()),
    ]
)


def pack(
    documents: DataFrame,
    tokenizer: str,
    end_id: int,
    weights: Mapping[str | None, float] | Sequence[float] | None = None,
    source_col: str | None = "source",
    by_word: bool = True,
    seed: int = 0,
) -> DataFrame:
    """One row per piece: ``doc_id, source, start, length, doc_tokens, sequence_id, offset, window, ids``.

    Each id of each document, with ``end_id`` after its last, is in exactly one piece; ``ids`` are
    little-endian unsigned 32-bit. ``weights`` are the target proportions by source; a source that is
    not named weighs nothing until the named ones are empty. A plain sequence of positive weights goes to the
    sources by their code points, null last, over and over. Without ``weights`` sources weigh what they hold, so
    that the mixture of the whole corpus holds in every window to the end.

    A null or empty text is its end id alone. Null sources are a source of their own, as are empty
    ones. Rows that repeat are packed once each. Very long texts are cut as need be. Columns other than
    ``doc_id``, ``text`` and the source are ignored. An empty table gives no pieces.
    """
    source = F.col(source_col) if source_col else F.lit("")
    rows = tokenized(documents, tokenizer, end_id, source, by_word)
    totals = rows.groupBy("source").agg(F.sum("n").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    names = {r["source"]: i for i, r in enumerate(totals)}
    if weights and not isinstance(weights, Mapping):
        shares = [weights[i % len(weights)] for i in range(len(totals))]
    elif weights:
        # Unnamed sources: so little that they wait for the rest.
        least = min((w for w in weights.values() if w > 0), default=1.0) * 1e-9
        shares = [max(weights.get(r["source"], 0), least) for r in totals]
    else:
        shares = [r["n"] for r in totals]
    schedule = Schedule([r["n"] for r in totals], shares)

    width = encoder(tokenizer, by_word).dtype

    def cut(batches: BatchesIn) -> Batches:
        for batch in small(batches):
            docs, sources, sizes, packed, starts = (column(batch, c) for c in ("doc_id", "source", "n", "ids", "start"))
            if not docs:
                continue
            runs, at, length, position = schedule.pieces([names[s] for s in sources], starts, sizes)
            for low in range(0, len(runs), PIECES):
                some = slice(low, low + PIECES)
                own = runs[some].tolist()
                ids = [
                    np.frombuffer(packed[r], width, n, a * width.itemsize).astype("<u4").tobytes()
                    for r, a, n in zip(own, at[some].tolist(), length[some].tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([docs[r] for r in own], pa.int64()),
                        pa.array([sources[r] for r in own], pa.string()),
                        pa.array(at[some]),
                        pa.array(length[some]),
                        pa.array([sizes[r] for r in own], pa.int64()),
                        pa.array(position[some] // SEQUENCE),
                        pa.array(position[some] % SEQUENCE),
                        pa.array(position[some] // schedule.window),
                        pa.array(ids, pa.binary()),
                    ],
                    schema=_PIECES,
                )

    places = queue_places(rows.drop("ids"), seed).select("row", "start").hint("shuffle_hash")
    return rows.join(places, "row").mapInArrow(cut, _PIECES_DDL)
