"""Phrase collocations by marginalising the longest windows.

Every word of a piece starts one window: itself and the next ``longest - 1`` words as lead columns, padded
with empty strings where the piece ends. Only these longest windows are counted. As each occurrence of a
shorter phrase is the beginning of exactly one window, ``ROLLUP (lang, word1, ..., word_n)`` over the counted
windows has the exact count of every phrase of every length, and of all words of a language.

Tasks count the windows of their texts in chunks of ``CHUNK_BYTES`` (one longer text alone is a chunk) and deal
each distinct window out once by a bucket of its first two words; the windows of a bucket travel as one text,
which takes less than half the space of a row for each. Where a bucket's texts meet, windows become exact, and words
from which on a phrase is rarer than ``least`` become padding: sums of shorter prefixes stay as they are, and
such a phrase could neither be a candidate nor a part of one. What ROLLUP and the joins behind it shuffle is
therefore the words and the frequent phrases only. There are ``BUCKETS`` buckets for every shuffle partition, so a
bucket is a small part of what a task is sized for: a frequent word's windows are spread by the word that
follows, of a frequent pair's windows a task sends each distinct one once.

Texts are lower-cased in A-Z, cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words ``[^\\x20\\x09]+``.

Odd input: null and empty texts have no words; a null ``lang`` counts as ``und``, as does the text ``und``;
repeated rows count as often as they occur; an empty table gives an empty result; columns besides ``lang`` and
``text`` are not read. Ties in score and count go by the phrase's UTF-8 bytes. Products are exact up to 38
digits (counts of up to 10 ** 16); beyond that Spark raises an error.
"""

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, BatchesIn, written

#: Text that a task counts at once.
CHUNK_BYTES = 12_000_000
#: Each language is ranked in so many parts before the parts' first rows meet.
RANK_PARTS = 64
#: Buckets of first two words for every shuffle partition.
BUCKETS = 8
#: Windows of an output batch.
ROWS = 50_000

BREAK = b"\n"
_CLEAN = bytearray(range(256))
_CLEAN[ord("A") : ord("Z") + 1] = range(ord("a"), ord("z") + 1)
for _byte in b".,;:!?\n\x0b\x0c\r":
    _CLEAN[_byte] = BREAK[0]
_CLEAN[ord("\t")] = ord(" ")
CLEAN = bytes(_CLEAN)


def tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, int]:
    """Distinct words of the texts, the words in order as indices into them, and the index of piece ends.

    Texts end pieces, too; the last token is a piece end.
    """
    data = BREAK.join([*texts, b""]).translate(CLEAN).replace(BREAK, b" \n ")
    split = pc.split_pattern(pa.array([data], pa.large_binary()), pattern=b" ").flatten()
    encoded = split.dictionary_encode()
    names, codes = encoded.dictionary, np.asarray(encoded.indices).astype(np.int64)
    empty, end = (names.index(pa.scalar(word, names.type)).as_py() for word in (b"", BREAK))
    return names, codes[codes != empty], end


def windows(codes: np.ndarray, end: int, distinct: int, longest: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Columns of the distinct padded windows, in order, and their counts. Padding has the index of piece ends."""
    columns, ended = [codes], codes == end
    starts = ~ended
    for ahead in range(1, longest):
        lead = np.full(len(codes), end, np.int64)
        lead[:-ahead] = codes[ahead:]
        ended = ended | (lead == end)
        lead[ended] = end
        columns.append(lead)
    key = columns[0][starts]
    beginnings = []
    for i, column in enumerate(columns[1:], 2):
        # Beginnings are numbered anew where the key of one more word could pass 64 bits.
        if i > 2 and distinct**i >= 2**63:
            known, key = np.unique(key, return_inverse=True)
            beginnings.append((i - 1, known))
        key = key * distinct + column[starts]
    key, counts = np.unique(key, return_counts=True)
    found: list[np.ndarray] = []
    for size in range(longest, 1, -1):
        if beginnings and beginnings[-1][0] == size:
            key = beginnings.pop()[1][key]
        found.append(key % distinct)
        key = key // distinct
    return [key, *reversed(found)], counts


def _lead_names(longest: int) -> list[str]:
    return [f"word{i}" for i in range(1, longest + 1)]


def _lines(names: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    """Windows as text, with spaces between the words."""
    return pc.binary_join_element_wise(*[names.take(pa.array(column)) for column in columns], pa.scalar(b" ", pa.binary()))


def _counted(batches: BatchesIn, longest: int, buckets: int) -> Batches:
    """Distinct windows of chunks of texts with their counts, those of a bucket in one row."""
    held: dict[str, list[bytes]] = {}
    size = 0

    def flush() -> Batches:
        for lang, texts in held.items():
            names, codes, end = tokens(texts)
            columns, counts = windows(codes, end, len(names), longest)
            shown = names.to_pylist()
            shown[end] = b""
            names = pa.array(shown, pa.binary())
            hashes = np.fromiter(map(crc32, shown), np.int64, len(shown))
            dealt = (hashes[columns[0]] * 31 + hashes[columns[1]]) % buckets
            order = np.argsort(dealt.astype(np.uint16 if buckets < 2**16 else np.int64), kind="stable")
            dealt = dealt[order]
            starts = np.flatnonzero(np.diff(dealt, prepend=-1))
            ends = np.append(starts[1:], len(dealt))
            low = 0
            while low < len(starts):
                high = max(low + 1, int(np.searchsorted(ends, starts[low] + ROWS, "right")))
                rows = order[starts[low] : ends[high - 1]]
                lines = _lines(names, [column[rows] for column in columns])
                offsets = pa.array(np.append(starts[low:high], ends[high - 1]) - starts[low], pa.int32())
                joined = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), BREAK)
                of_lines = pa.ListArray.from_arrays(offsets, pa.array(counts[rows], pa.int64()))
                langs = pa.repeat(pa.scalar(lang, pa.string()), high - low)
                bucket = pa.array(dealt[starts[low:high]], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [langs, bucket, joined.cast(pa.string()), of_lines], ["lang", "bucket", "windows", "counts"]
                )
                low = high

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            data = text.as_buffer().to_pybytes()
            if size and size + len(data) > CHUNK_BYTES:
                yield from flush()
                held, size = {}, 0
            held.setdefault(lang.as_py(), []).append(data)
            size += len(data)
    yield from flush()


def _sums(values: pa.Array, counts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct values, their summed counts, and which of them each value is."""
    encoded = values.dictionary_encode()
    which = np.asarray(encoded.indices)
    total = np.zeros(len(encoded.dictionary), np.int64)
    np.add.at(total, which, counts)
    return encoded.dictionary, total, which


def exact_windows(bucket: pa.Table, longest: int, least: int) -> pa.Table:
    """The windows of a bucket with exact counts, padded from where their beginnings are rarer than ``least``."""
    lines = pc.split_pattern(bucket["windows"].cast(pa.large_binary()), pattern=BREAK).combine_chunks().flatten()
    counts = np.asarray(pc.list_flatten(bucket["counts"]).combine_chunks())
    distinct, totals, _ = _sums(lines, counts)
    split = pc.split_pattern(distinct, pattern=b" ").flatten()
    words = [split.take(pa.array(np.arange(i, len(split), longest))) for i in range(longest)]
    # All windows that begin with a word's pair lie in this bucket, all that begin with the word do not.
    frequent = []
    head = words[0]
    for word in words[1:]:
        head = pc.binary_join_element_wise(head, word, pa.scalar(b" ", head.type))
        _, of_head, which = _sums(head, totals)
        frequent.append(pa.array(of_head[which] >= least))
    nothing = pa.scalar(b"", split.type)
    words[1:] = [pc.if_else(often, word, nothing) for often, word in zip(frequent, words[1:], strict=True)]
    kept, totals, _ = _sums(pc.binary_join_element_wise(*words, pa.scalar(b" ", split.type)), totals)
    split = pc.split_pattern(kept, pattern=b" ").flatten()
    columns = [split.take(pa.array(np.arange(i, len(split), longest))).cast(pa.string()) for i in range(longest)]
    langs = pa.repeat(pa.scalar(bucket["lang"][0].as_py(), pa.string()), len(kept))
    return pa.Table.from_arrays([langs, *columns, pa.array(totals)], ["lang", *_lead_names(longest), "n"])


def padded_windows(documents: DataFrame, least: int = 10, longest: int = 3) -> DataFrame:
    """``lang``, ``word1`` and so on (padding: empty), ``n``: what ROLLUP sums up."""
    texts = documents.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where(F.length("text") > 0)
    buckets = BUCKETS * int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = texts.mapInArrow(
        lambda batches: _counted(batches, longest, buckets), "lang string, bucket long, windows string, counts array<long>"
    )
    columns = ", ".join(f"{name} string" for name in _lead_names(longest))
    return dealt.groupBy("lang", "bucket").applyInArrow(
        lambda bucket: exact_windows(bucket, longest, least), f"lang string, {columns}, n long"
    )


def phrase_counts(documents: DataFrame, least: int = 10, longest: int = 3) -> DataFrame:
    """``lang``, ``phrase``, ``size`` (its words) and ``n`` of all phrases counted ``least`` times or more.

    The row of ``size`` 0 has the number of all words of the language.
    """
    names = _lead_names(longest)
    rolled = padded_windows(documents, least, longest).rollup("lang", *names).agg(F.sum("n").alias("n"), F.grouping_id().alias("left_out"))
    sizes = {(1 << (longest - size)) - 1: size for size in range(longest + 1)}
    size = F.lit(None).cast("int")
    padded = F.lit(False)
    for left_out, words in sizes.items():
        size = F.when(F.col("left_out") == left_out, words).otherwise(size)
        if words:
            padded = F.when(F.col("left_out") == left_out, F.col(names[words - 1]) == "").otherwise(padded)
    phrases = rolled.select("lang", F.concat_ws(" ", *names).alias("phrase"), size.alias("size"), "n", padded.alias("padded"))
    return phrases.where(F.col("size").isNotNull() & ~F.col("padded") & ((F.col("size") == 0) | (F.col("n") >= least))).drop("padded")


def _score(a: Column, left: Column, right: Column) -> Column:
    """``floor(1000000 * a * a / (left * right))`` in decimals, whose integral division is exact."""
    wide = [c.cast("decimal(19,0)") for c in (a, left, right)]
    above = (wide[0] * wide[0]).cast("decimal(38,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    return F.call_function("div", above.cast("decimal(38,0)"), (wide[1] * wide[2]).cast("decimal(38,0)")).cast("long")


def collocations(
    documents: DataFrame, least: int = 10, longest: int = 3, share: int = 50, top: int = 2000
) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    Candidates are phrases of 2 to ``longest`` words counted ``least`` times or more, scored by their weakest
    cut into two. Those inside a longer candidate that has ``share`` percent of their count or more are dropped.
    """
    counts = written(phrase_counts(documents, least, longest), "phrases")
    parts = counts.where("size > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("of_part"))
    candidates = counts.where("size > 1").select(
        "lang", "phrase", "size", F.col("n").alias("a"), F.split("phrase", " ", -1).alias("words")
    )

    def joined(low: Column, length: Column) -> Column:
        return F.array_join(F.slice("words", low, length), " ")

    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k",
        joined(F.lit(1), F.col("k")).alias("first"),
        joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"),
    )
    for part, name in (("first", "l"), ("rest", "r")):
        of_part = parts.withColumnsRenamed({"part": part, "of_part": name})
        cuts = cuts.join(of_part, ["lang", part])
    weakest = cuts.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut")
    )
    # Phrases inside longer candidates, by the most frequent of these.
    spans = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("size") - 1),
            lambda length: F.transform(
                F.sequence(F.lit(1), F.col("size") - length + 1), lambda low: joined(low, length)
            ),
        )
    )
    inside = candidates.where("size > 2").select("lang", F.explode(spans).alias("phrase"), F.col("a").alias("longer"))
    covered = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    free = weakest.join(covered, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a"))
    )
    rows = free.select("lang", "phrase", "a", "cut.*")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    first = rows.withColumn("at", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("at") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = counts.where("size = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
