"""Mixing overlapping sources to target weights, by a min-cost flow over membership patterns.

Documents that belong to the same set of sources are alike for the mixture: they are aggregated to
one pattern with a capacity in words. A small network routes capacity to source quotas: each pattern
can be taken once, twice and three times, every repetition at a higher cost, so the cheapest flow
repeats as little as the quotas allow. A pattern's flow then means: all its documents so many times,
and once more those that come first in a seeded order, up to the remaining words.

The order is a hash of seed, id and text. Its cut-off is found from sums by hash block and then
within one block per pattern, so no task gets a whole pattern, and documents learn their fate from
their own hash and the pattern's row.
"""

from collections.abc import Mapping, Sequence
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Batches, BatchesIn, column, small, written

#: Cost of a word's first, second and third use. Nothing is used more often.
REPETITION_COSTS = (0, 1, 3)
#: Membership patterns that the flow may have: some hundred bytes each.
MAX_PATTERNS = 100_000
#: Documents of a pattern that one task puts in order.
BLOCK_ROWS = 20_000
#: Documents added one by one to a pattern whose cut-off falls within a document.
FILLS = 4


def share_out(sizes: Mapping[str | None, int], weights: Sequence[float] = (1, 2, 3), limit: float = 3.0) -> dict:
    """Target words of each source. Sources in order of their code points, null last, take turns with
    the weights and share all words; none gets more than ``limit`` times its size, and what is over
    is shared by the others by weight."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    targets, rest, active = {}, float(sum(sizes.values())), set(names)
    while active:
        unit = rest / sum(weight[s] for s in active)
        full = [s for s in active if unit * weight[s] > limit * sizes[s]]
        if not full:
            return targets | {s: unit * weight[s] for s in active}
        for s in full:
            targets[s] = limit * sizes[s]
            active.discard(s)
        rest -= sum(limit * sizes[s] for s in full)
    return targets


def min_cost_flow(capacities: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int]) -> list[dict[int, int]]:
    """Words from each pattern to each source: all that quotas and three uses allow, at the least cost.

    Successive cheapest paths. A path enters one pattern and costs what that use of it costs; what it does
    after that, moving other patterns' words between their sources, is free. So there are as many costs of
    paths as uses, and all paths of one cost go together, as blocking flows over the shortest of them.
    Patterns of one source that has room need no search: one round over all links serves them.
    """
    flows = [dict.fromkeys(own, 0) for own in members]
    users: list[list[int]] = [[] for _ in quotas]
    for p, own in enumerate(flows):
        for s in own:
            users[s].append(p)
    left, room = [0] * len(capacities), list(quotas)
    for _ in REPETITION_COSTS:
        left = [a + b for a, b in zip(left, capacities, strict=True)]
        while _blocking_flow(flows, users, left, room):
            pass
    return [{s: words for s, words in own.items() if words} for own in flows]


def _levels(flows: list[dict[int, int]], users: list[list[int]], left: list[int], room: list[int]) -> tuple[dict, dict]:
    """Distances of patterns and sources from the patterns with words left, up to the first source with room."""
    patterns = {p: 0 for p, words in enumerate(left) if words}
    sources: dict[int, int] = {}
    front, depth = list(patterns), 0
    while front:
        reached = list(dict.fromkeys(s for p in front for s in flows[p] if s not in sources))
        sources.update(dict.fromkeys(reached, depth + 1))
        if any(room[s] for s in reached):
            break
        front = list(dict.fromkeys(p for s in reached for p in users[s] if flows[p][s] and p not in patterns))
        depth += 2
        patterns.update(dict.fromkeys(front, depth))
    return patterns, sources


def _blocking_flow(flows: list[dict[int, int]], users: list[list[int]], left: list[int], room: list[int]) -> bool:
    """Send words along shortest paths until none is left; whether any were sent."""
    patterns, sources = _levels(flows, users, left, room)
    roots = [p for p, depth in patterns.items() if not depth]
    onward: dict[int, list[int]] = {}  # sources that a pattern may still send to
    back: dict[int, list[int]] = {}  # patterns that may take their words out of a source
    sent = False
    for root in roots:
        path = [root]  # patterns and sources in turn
        while left[root]:
            here = path[-1]
            if len(path) % 2:
                ahead = onward.setdefault(here, [s for s in flows[here] if sources.get(s) == patterns[here] + 1])
                usable = bool(ahead)
            elif room[here]:
                takes = list(zip(path[2::2], path[1::2], strict=False))
                amount = min(left[root], room[here], *(flows[p][s] for p, s in takes))
                for p, s in takes:
                    flows[p][s] -= amount
                for p, s in zip(path[::2], path[1::2], strict=True):
                    flows[p][s] += amount
                left[root] -= amount
                room[here] -= amount
                sent, path = True, [root]
                continue
            else:
                ahead = back.setdefault(here, [p for p in users[here] if patterns.get(p) == sources[here] + 1])
                while ahead and not flows[ahead[-1]][here]:
                    ahead.pop()
                usable = bool(ahead)
            if usable:
                path.append(ahead[-1])
            elif len(path) == 1:
                break
            else:
                path.pop()
                (onward if len(path) % 2 else back)[path[-1]].pop()
    return sent


def _sizes(batches: BatchesIn) -> Batches:
    for batch in small(batches):
        sizes = [len(text.encode("utf-8", "replace").split()) if text else 0 for text in column(batch, "text")]
        fields = batch.select(["doc_id", "sources", "key"])
        yield pa.RecordBatch.from_arrays(
            [*fields.columns, pa.array(sizes, pa.int64())], names=[*fields.schema.names, "size"]
        )


def _order(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "text")


def _pattern(sources: Column) -> Column:
    """The set of sources in order; a null list is a list of one null."""
    return F.array_sort(F.array_distinct(F.coalesce(sources, F.array(F.lit(None).cast("string")))))


class Mixture:
    """What to take of each pattern, see ``mix``."""

    def __init__(self, sized: DataFrame, targets: dict, decisions: DataFrame, source_sizes: dict):
        self.sized, self.targets, self.decisions, self.source_sizes = sized, targets, decisions, source_sizes


def plan_mixture(documents: DataFrame, sources: Column, targets=share_out, seed: int = 0) -> Mixture:
    """Sizes, targets and decisions for ``documents`` (``doc_id``, ``text``) in the given ``sources``.

    ``sources`` is an array of strings by row, ``targets`` a function from source sizes to words. A
    document of several sources counts for each of them. Target words are met to within a word
    by the flow, where it has enough documents, and by the selection to within about half of the
    smallest document that is left of a pattern.
    """
    plain = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", _pattern(sources.cast("array<string>")).alias("sources")
    ).withColumn("key", _order(seed))
    sized = written(
        plain.mapInArrow(_sizes, "doc_id long, sources array<string>, key long, size long"), "sizes"
    )
    found = sized.groupBy("sources").agg(F.sum("size").alias("size"), F.count("*").alias("n")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns")
    found.sort(key=lambda r: [(s is None, s or "") for s in r["sources"]])
    source_sizes: dict = {}
    for r in found:
        for s in r["sources"]:
            source_sizes[s] = source_sizes.get(s, 0) + r["size"]
    goal = targets(source_sizes)
    names = sorted(goal, key=lambda s: (s is None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    flows = min_cost_flow(
        [r["size"] for r in found], [[number[s] for s in r["sources"] if s in number] for r in found], [round(goal[s]) for s in names]
    )
    wanted = [
        (r["sources"], *(divmod(sum(flow.values()), r["size"]) if r["size"] else (0, 0)))
        for r, flow in zip(found, flows, strict=True)
    ]
    schema = T.StructType(
        [
            T.StructField("sources", T.ArrayType(T.StringType())),
            T.StructField("copies", T.LongType()),
            T.StructField("words", T.LongType()),
        ]
    )
    quotas = documents.sparkSession.createDataFrame(wanted, schema)
    blocks = max(1, ceil(sum(r["n"] for r in found) / BLOCK_ROWS))
    return Mixture(sized, goal, _cut_offs(sized, quotas, blocks), source_sizes)


def _cut_offs(sized: DataFrame, quotas: DataFrame, blocks: int) -> DataFrame:
    """``(sources, copies, last, extra)``: the last key that is taken once more, and a few keys beyond.

    There is one row per pattern.
    """
    # The top bits of the key, so that blocks are in the order of the key.
    rows = sized.where("size > 0").withColumn(
        "block", F.floor((F.col("key") / F.lit(2.0**64) + 0.5) * F.lit(blocks)).cast("long")
    )
    partial = quotas.where("words > 0")
    sums = rows.groupBy("sources", "block").agg(F.sum("size").alias("block_size"))
    so_far = Window.partitionBy("sources").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = (
        sums.withColumn("ahead", F.coalesce(F.sum("block_size").over(so_far), F.lit(0)))
        .join(F.broadcast(partial), "sources")
        .where("ahead <= words and words < ahead + block_size")
        .select("sources", "block", "ahead", "words")
    )
    within = Window.partitionBy("sources").orderBy("key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    fits = (
        rows.join(F.broadcast(at), ["sources", "block"])
        .withColumn("upto", F.col("ahead") + F.sum("size").over(within))
        .where("upto <= words")
        .groupBy("sources")
        .agg(F.max("key").alias("last"), F.max("upto").alias("taken"))
    )
    # Where not even the block's first document fits, all keys of earlier blocks are taken.
    before_block = F.when(F.col("block") == 0, F.lit(-(2**63))).otherwise(
        ((F.col("block") / F.lit(float(blocks)) - 0.5) * F.lit(2.0**64)).cast("long") - 1
    )
    state = at.join(fits, "sources", "left").select(
        "sources",
        F.coalesce("last", before_block).alias("last"),
        (F.col("words") - F.coalesce("taken", "ahead")).alias("gap"),
        F.array().cast("array<long>").alias("extra"),
    )
    def with_one_more(state: DataFrame, over: bool) -> DataFrame:
        """The largest document that fits the gap, or the smallest that overshoots by less than the gap."""
        state = written(state, "cut-offs")
        fits = (F.col("size") > F.col("gap")) & (F.col("size") < 2 * F.col("gap")) if over else F.col("size") <= F.col("gap")
        beyond = rows.join(F.broadcast(state), "sources").where(
            (F.col("key") > F.col("last")) & ~F.array_contains("extra", F.col("key"))
        )
        # Rows that share a key are taken together.
        each = beyond.groupBy("sources", "key").agg(F.sum("size").alias("size"), F.first("gap").alias("gap")).where(fits)
        pick = F.min if over else F.max
        best = each.groupBy("sources").agg(pick(F.struct("size", "key")).alias("best"))
        return state.join(best, "sources", "left").select(
            "sources",
            "last",
            (F.col("gap") - F.coalesce(F.col("best.size"), F.lit(0))).alias("gap"),
            F.when(F.col("best").isNull(), F.col("extra")).otherwise(F.concat("extra", F.array("best.key"))).alias("extra"),
        )

    for _ in range(FILLS):
        state = with_one_more(state, over=False)
    state = with_one_more(state, over=True)
    return quotas.join(state, "sources", "left").select("sources", "copies", "last", "extra")


def _times(rows: DataFrame, decisions: DataFrame) -> DataFrame:
    """Rows with ``sources`` and ``key``, and how often to take them. Decisions are one row a pattern,
    ``MAX_PATTERNS`` at most."""
    more = (F.col("key") <= F.col("last")) | F.array_contains("extra", F.col("key"))
    return rows.join(F.broadcast(decisions), "sources", "left").withColumn(
        "times", F.coalesce("copies", F.lit(0)) + F.when(more, 1).otherwise(0)
    )


def mix(documents: DataFrame, source_col: str = "source", seed: int = 0) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for each row of ``documents``.

    The size is the number of words of the text, 0 for null. ``taken`` counts the words the mixture
    takes of the row, repeats included, at most three times its size. Rows that are equal in id and
    text are taken alike. Null sources are a source of their own. Rows without words are in the result
    and take nothing; an empty table gives an empty result. Other columns are ignored.
    """
    mixture = plan_mixture(documents, F.array(source_col), seed=seed)
    facts = documents.sparkSession.createDataFrame(
        [([s], mixture.source_sizes[s], float(t)) for s, t in mixture.targets.items()],
        "sources array<string>, source_size long, target double",
    )
    return (
        _times(mixture.sized, mixture.decisions)
        .join(F.broadcast(facts), "sources")
        .select(
            "doc_id",
            F.col("sources")[0].alias("source"),
            "size",
            "source_size",
            "target",
            (F.col("size") * F.col("times")).alias("taken"),
        )
    )


def mixed_documents(documents: DataFrame, sources: Column, seed: int = 0) -> DataFrame:
    """The mixture itself: rows of ``documents``, all columns, each as often as it is taken.

    Rows without words are no part of any target; they stay, once.
    """
    mixture = plan_mixture(documents, sources, seed=seed)
    marked = documents.select(
        F.struct(*[documents[c] for c in documents.columns]).alias("row"),
        _pattern(sources.cast("array<string>")).alias("sources"),
        F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), "text").alias("key"),
    )
    wordless = ~F.coalesce(F.col("row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    times = F.when(wordless, 1).otherwise(F.col("times")).cast("int")
    return (
        _times(marked, mixture.decisions)
        .select("row", F.explode(F.array_repeat(F.lit(0), times)))
        .select("row.*")
    )
