"""Point-in-time histories: for each ``(customer_id, day)`` the newest actions before that day.

The window of a key is ``[day - lookback, day)``, whole calendar days. Instead of joining every key
with every action of its window and ranking the pairs, actions get a position on their customer's
time line and a key's history is a *position range* of at most ``max_seq`` entries:

1. ``cap_daily`` keeps the ``max_seq`` newest actions of each customer's day. A window holds whole
   days, so an action that is not among the newest ``max_seq`` of its own day is not among the
   newest ``max_seq`` of any window: nothing that could be in a result is lost.
2. What is left is counted per customer and day. Only these daily counts of a customer meet in one
   task; running sums over them give each day its offset and each key its positions.
3. An action's position is its day's offset plus its place within the day. Actions are collected in
   blocks of a few ``max_seq`` positions, overlapping by ``max_seq``, so that a key's range is a slice
   of the one block that its newest entry is in.

Before all that, ``reachable_actions`` drops what no key of its customer can look back to, by a semi join in
front of the first shuffle.

No pair of key and action is built; work is linear in actions, keys and output entries. Days and
blocks of a customer lie in different tasks, so a hot customer is split however many actions it has:
no step brings the actions of a customer together.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..constants import COL_ACTION_TYPE, COL_CUSTOMER_ID, COL_ITEM_ID, COL_TS
from ..functions import epoch_day, require_same_kind, whole_number

ORDERS = ("recent_first", "oldest_first")

# Positions of a block, in ``max_seq``. One in so many actions goes to two blocks.
BLOCK = 4


def check_window(lookback_days: int, max_seq: int = 1) -> tuple[int, int]:
    """Both parameters as integers; ``ValueError`` for anything that is not a whole number in range."""
    return whole_number("lookback_days", lookback_days, 0), whole_number("max_seq", max_seq, 1)


def usable_actions(actions: DataFrame) -> DataFrame:
    """Actions that can be part of a history, with their day number.

    That the day is not null follows; saying so keeps the optimizer from adding it to one use of the
    result only, and so lets all uses share one shuffle.
    """
    usable = actions.where(F.col(COL_CUSTOMER_ID).isNotNull() & F.col(COL_TS).isNotNull())
    return _with_day(usable)


def _with_day(actions: DataFrame) -> DataFrame:
    return actions.withColumn("day", epoch_day(F.col(COL_TS))).where("day is not null")


def reachable_actions(actions: DataFrame, keys: DataFrame, lookback_days: int) -> DataFrame:
    """The actions with a ``day`` that some key of their customer may reach.

    Time is cut into periods of ``lookback_days``; a key's window lies in two of them, so the keys become few distinct pairs of customer and period, and the logs are semi-joined
    with these. Spark broadcasts the pairs if they are small; if not, it may filter the logs' scans with a
    Bloom filter of them, and split a hot customer's partition, since what follows is dealt out by day.
    """
    if not lookback_days:
        return actions.where(F.lit(False))

    def period(day: Column) -> Column:
        return F.floor(day / lookback_days).cast("int")

    reach = F.explode(F.sequence(period(F.col("day") - lookback_days), period(F.col("day") - 1)))
    pairs = keys.select(COL_CUSTOMER_ID, reach.alias("period")).distinct()
    return actions.withColumn("period", period(F.col("day"))).join(pairs, [COL_CUSTOMER_ID, "period"], "left_semi").drop("period")


def _splits(spark: SparkSession) -> int:
    """Tasks that share one day of a customer: one for every 64 map tasks, if there are as many of
    those as shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions")) // 64 + 1


def cap_daily(actions: DataFrame, max_seq: int, splits: int | None = None) -> DataFrame:
    """The ``max_seq`` newest actions of each customer and day, with their rank ``back`` (1: newest).

    They are ranked map-side, then by split (a set of map tasks), and what is left of the splits once
    more by day: a task gets at most ``max_seq`` rows of a day from each map task of a split, or
    from each split. A single split is the day itself and ranked once.
    """
    splits = splits or _splits(actions.sparkSession)
    recency = (F.desc(COL_TS), F.desc(COL_ACTION_TYPE), F.desc(COL_ITEM_ID))
    in_split = Window.partitionBy(COL_CUSTOMER_ID, "day", "_split").orderBy(*recency)
    in_day = Window.partitionBy(COL_CUSTOMER_ID, "day").orderBy(*recency)
    if splits > 1:
        by_split = actions.withColumn("_split", F.spark_partition_id() % splits)
        newest = by_split.withColumn("back", F.row_number().over(in_split)).where(F.col("back") <= max_seq)
        actions = newest.drop("_split", "back")
    return actions.withColumn("back", F.row_number().over(in_day)).where(F.col("back") <= max_seq)


def _day_lines(daily: DataFrame, keys: DataFrame, lookback_days: int, max_seq: int) -> DataFrame:
    """Daily counts and keys of a customer on one line: a row per day of either, with the actions
    before it (``offset``) and how many of them are a key's history (``length``).

    Days that no key can reach count nothing, so positions are gapless without them.
    """
    line = Window.partitionBy(COL_CUSTOMER_ID).orderBy("day")
    before = line.rangeBetween(Window.unboundedPreceding, -1)
    before_window = line.rangeBetween(Window.unboundedPreceding, -(lookback_days + 1))
    zero = F.lit(0).cast("long")
    offset = F.coalesce(F.sum("n").over(before), zero)
    expired = F.coalesce(F.sum("n").over(before_window), zero)
    # With no look-back the frame is empty and nothing is reached.
    reached = F.count_if("is_key").over(line.rangeBetween(1, lookback_days)) > 0 if lookback_days else F.lit(False)
    return (
        daily.withColumn("is_key", F.lit(False))
        .unionByName(keys.select(COL_CUSTOMER_ID, "day", zero.alias("n"), F.lit(True).alias("is_key")))
        .withColumn("n", F.when(reached, F.col("n")).otherwise(zero))
        .select(
            COL_CUSTOMER_ID,
            "day",
            "n",
            "is_key",
            offset.alias("offset"),
            F.least(F.lit(max_seq), offset - expired).cast("int").alias("length"),
        )
    )


def keyed_history(
    keys: DataFrame,
    actions: DataFrame,
    *,
    lookback_days: int,
    max_seq: int,
    order: str = "recent_first",
) -> DataFrame:
    """``(customer_id, day, items, types)`` for each key that has a history.

    ``keys`` holds distinct, non-null ``(customer_id, day)``, ``actions`` normalised actions. The
    arrays are parallel and unpadded, 1 to ``max_seq`` long. Recency is ``ts``, then action type,
    then item, all descending; whatever the ``order``, the newest ``max_seq`` entries are kept.
    Actions that no key can reach are dropped before they are collected.
    """
    lookback_days, max_seq = check_window(lookback_days, max_seq)
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}, got {order!r}")
    require_same_kind(COL_CUSTOMER_ID, {"impressions": keys, "actions": actions})

    # The day is computed anew: as a mere column of the semi join, one use of the capped actions would get it under
    # another name where there are splits, and the uses would not share the shuffles up to here.
    reachable = _with_day(reachable_actions(usable_actions(actions), keys, lookback_days).drop("day"))
    capped = cap_daily(reachable, max_seq)
    return capped_history(keys, capped, lookback_days=lookback_days, max_seq=max_seq, order=order)


def capped_history(
    keys: DataFrame, capped: DataFrame, *, lookback_days: int, max_seq: int, order: str = "recent_first"
) -> DataFrame:
    """``keyed_history`` of actions that ``cap_daily`` has cut to ``max_seq`` a day."""
    daily = capped.groupBy(COL_CUSTOMER_ID, "day").agg(F.count("*").alias("n"))
    lines = _day_lines(daily, keys, lookback_days, max_seq)

    # Positions count from 0 at the oldest action. A block's last ``max_seq`` go to the next one, too, so
    # that a key finds all its entries, positions [offset - length, offset), in the block of its newest.
    size = BLOCK * max_seq
    days = lines.where("not is_key and n > 0").select(COL_CUSTOMER_ID, "day", "n", "offset")
    position = F.col("position")
    block = F.expr(f"position div {size}")
    late = position % size >= size - max_seq
    placed = (
        capped.join(days, [COL_CUSTOMER_ID, "day"])
        .withColumn("position", F.col("offset") + F.col("n") - F.col("back"))
        .select(
            COL_CUSTOMER_ID,
            F.explode(F.when(late, F.array(block, block + 1)).otherwise(F.array(block))).alias("block"),
            F.struct(position, COL_ITEM_ID, COL_ACTION_TYPE).alias("entry"),
        )
    )
    asking = lines.where("is_key and length > 0").select(
        COL_CUSTOMER_ID, F.expr(f"(offset - 1) div {size}").alias("block"), F.struct("day", "offset", "length").alias("key")
    )
    blocks = (
        placed.unionByName(asking, allowMissingColumns=True)
        .groupBy(COL_CUSTOMER_ID, "block")
        .agg(F.sort_array(F.collect_list("entry"), asc=False).alias("newest"), F.collect_list("key").alias("keys"))
    )
    # Entries of the block that are younger than the key.
    skip = (F.col("newest")[0]["position"] + 1 - F.col("key.offset")).cast("int")
    parts = blocks.select(COL_CUSTOMER_ID, F.explode("keys").alias("key"), "newest").select(
        COL_CUSTOMER_ID, F.col("key.day").alias("day"), F.slice("newest", skip + 1, F.col("key.length")).alias("entries")
    )
    entries = F.reverse("entries") if order == "oldest_first" else F.col("entries")
    return parts.select(COL_CUSTOMER_ID, "day", entries.alias("entries")).select(
        COL_CUSTOMER_ID,
        "day",
        F.col(f"entries.{COL_ITEM_ID}").alias("items"),
        F.col(f"entries.{COL_ACTION_TYPE}").alias("types"),
    )
