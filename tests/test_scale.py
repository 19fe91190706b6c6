"""Skew, partitioning and plan shape."""

import random
import re
from contextlib import contextmanager
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import hindsight
from .fixtures import brute_force, ranking, rows, sources

HOT = 7

NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
}


@contextmanager
def settings(spark, values):
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def skewed(spark, seed):
    """Customer 7 owns a third of everything, much of it on one day and at one instant."""
    rng = random.Random(seed)
    start = datetime(2025, 1, 1)

    def customer():
        return HOT if rng.random() < 0.34 else rng.choice([None, 1, 2, 3, 4, 5, 6])

    def instant():
        day = 20 if rng.random() < 0.3 else rng.randrange(60)
        return start + timedelta(days=day, seconds=rng.choice([0, 0, 3600, rng.randrange(86400)]))

    def action(*extra):
        at = instant()
        return (at.date().isoformat(), customer(), rng.choice([None, *range(1, 9)]), *extra, at)

    rankings = []
    for i in range(60):
        dt = (start + timedelta(days=rng.randrange(-3, 65))).date().isoformat()
        items = [(rng.randrange(1, 5), rng.random() < 0.5) for _ in range(rng.randrange(4))]
        rankings.append(ranking(rng.choice([dt, dt, dt, "bad"]), f"r{i}", customer(), *items))
    clicks = [action() for _ in range(200)]
    carts = [action(1) for _ in range(150)]
    orders = [(instant().date(), customer(), rng.randrange(1, 9), 1) for _ in range(150)]
    return sources(spark, rankings, clicks, carts, orders)


@pytest.mark.parametrize(
    "seed, lookback_days, max_seq",
    [(1, 7, 3), (2, 30, 1), (3, 365, 17), (4, 14, 10), (5, 60, 400), (6, 5, 2), (7, 0, 4), (8, 1, 50)],
)
def test_skewed_histories_against_brute_force(spark, seed, lookback_days, max_seq):
    inputs = skewed(spark, seed)
    expected = brute_force(*inputs, lookback_days, max_seq)
    spread = [df.repartition(5 + i) for i, df in enumerate(inputs)]
    out = hindsight.build_training_inputs(*spread, lookback_days=lookback_days, max_seq=max_seq)
    assert rows(out) == expected


def test_oldest_first_against_brute_force(spark):
    inputs = skewed(spark, 8)
    out = hindsight.build_training_inputs(*inputs, lookback_days=20, max_seq=6, order="oldest_first")
    assert rows(out) == brute_force(*inputs, 20, 6, oldest_first=True)


def test_result_does_not_depend_on_partitions(spark):
    inputs = skewed(spark, 9)
    one = hindsight.build_training_inputs(*[df.coalesce(1) for df in inputs], lookback_days=30, max_seq=5)
    many = hindsight.build_training_inputs(*[df.repartition(13) for df in inputs], lookback_days=30, max_seq=5)
    assert rows(one) == rows(many)


def hot_actions(spark, n=50_000, days=365, tasks=16):
    """One customer's actions, spread over a year and over many map tasks."""
    return spark.range(0, n, 1, tasks).select(
        F.lit(HOT).alias("customer_id"),
        F.col("id").cast("int").alias("item_id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919 % n) * F.lit(days * 86400) / n).alias("ts"),
        F.lit(1).cast("tinyint").alias("action_type"),
    )


@pytest.mark.parametrize("splits", [None, 1, 5])
def test_daily_cap_is_exact(spark, splits):
    from hindsight.operators import cap_daily
    from hindsight.operators.history import usable_actions

    usable = usable_actions(hot_actions(spark))
    capped = cap_daily(usable, 10, splits)
    days = usable.select("day").distinct().count()
    assert days in (365, 366) and capped.count() == 10 * days
    newest = Window.partitionBy("day").orderBy(F.desc("ts"), F.desc("item_id"))
    expected = usable.withColumn("back", F.row_number().over(newest)).where("back <= 10")
    assert rows(capped.select("item_id", "back")) == rows(expected.select("item_id", "back"))


def test_hot_customer_is_split(spark):
    """No task gets a customer's actions: only days meet by customer, and blocks hold ``max_seq``."""
    impressions, _, carts, orders = sources(spark, [ranking("2024-10-01", f"r{i}", HOT, (1, False)) for i in range(3)])
    clicks = hot_actions(spark).select("customer_id", "item_id", F.col("ts").alias("click_time"))
    with settings(spark, {**NO_BROADCAST, "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64"}):
        out = hindsight.build_training_inputs(impressions, clicks, carts, orders, lookback_days=200, max_seq=10)
        text = plan(out)
        assert len(out.collect()) == 3
    exchanges = [x for x in text.splitlines() if re.search(r" Exchange hashpartitioning\(customer_id#\d+, \d+\)", x)]
    assert len([x for x in exchanges if "ReusedExchange" not in x]) == 1
    for line in re.findall(r"Window \[.*", text):
        if re.search(r"\], \[customer_id#\d+\], ", line):
            assert "sum(n#" in line or "is_key#" in line


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_has_no_pair_join(spark):
    inputs = [df.repartition(3) for df in skewed(spark, 1)]
    text = plan(hindsight.build_training_inputs(*inputs, lookback_days=30, max_seq=5))
    # Days come to their actions, and histories to their rankings.
    joins = re.findall(r"(?:SortMerge|BroadcastHash|ShuffledHash)Join .*", text)
    assert len([join for join in joins if "LeftSemi" not in join]) == 2
    assert "LeftOuter" in text
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "WindowGroupLimit" in text


def test_actions_of_others_cross_no_exchange(spark, tmp_path):
    """Only customers with impressions have their actions shuffled."""
    impressions, _, carts, orders = sources(spark, [ranking("2024-10-01", "r", HOT, (1, False))])
    impressions.write.parquet(str(tmp_path / "impressions"))
    impressions = spark.read.parquet(str(tmp_path / "impressions"))
    clicks = spark.range(0, 20_000, 1, 4).select(
        F.lit("2024-09-30").alias("dt"), F.col("id").cast("int").alias("customer_id"), F.lit(3).alias("item_id"),
        F.lit(datetime(2024, 9, 30, 10)).alias("click_time"),
    )
    out = hindsight.build_training_inputs(impressions, clicks, carts, orders, lookback_days=30, max_seq=2)
    assert [row.actions for row in out.collect()] == [[3, 0]]
    written = []
    stack = [out._jdf.queryExecution().executedPlan()]
    while stack:
        node = stack.pop()
        name = node.nodeName()
        if name == "Exchange":
            written.append(node.metrics().apply("shuffleRecordsWritten").value())
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in name else []
        children = node.children()
        stack += inner + [children.apply(i) for i in range(children.size())]
    assert written and max(written) <= 10


@pytest.mark.parametrize("lookback_days", [1, 2, 7, 365])
def test_reachable_actions(spark, lookback_days):
    from hindsight.operators.history import reachable_actions

    rng = random.Random(lookback_days)
    keys = {(rng.randrange(6), rng.randrange(-400, 800)) for _ in range(9)}
    actions = [(rng.randrange(8), day) for day in range(-900, 900, 3)]
    kept = reachable_actions(
        spark.createDataFrame(actions, "customer_id int, day int"),
        spark.createDataFrame(sorted(keys), "customer_id int, day int"),
        lookback_days,
    )
    kept = {tuple(row) for row in kept.collect()}
    needed = {a for a in actions if any(a[0] == c and d - lookback_days <= a[1] < d for c, d in keys)}
    assert needed <= kept and all(any(a[0] == c and abs(a[1] - d) <= 2 * lookback_days for c, d in keys) for a in kept)


def test_each_log_is_read_once(spark, tmp_path):
    names = ("impressions", "clicks", "carts", "orders")
    for name, df in zip(names, skewed(spark, 1)):
        df.write.parquet(str(tmp_path / name))
    inputs = [spark.read.parquet(str(tmp_path / name)) for name in names]
    with settings(spark, {"spark.sql.adaptive.enabled": "false"}):
        final = plan(hindsight.build_training_inputs(*inputs, lookback_days=30, max_seq=5))
    for time in ("click_time", "occurred_at", "order_date"):
        assert len(re.findall(rf"FileScan parquet \[[^\]]*{time}", final)) == 1


def test_hot_key_is_split_in_the_last_join(spark):
    impressions, clicks, carts, orders = sources(spark, [])
    impressions = spark.range(0, 40_000, 1, 8).select(
        F.lit("2025-07-31").alias("dt"),
        F.uuid().alias("ranking_id"),
        F.when(F.col("id") % 3 == 0, HOT).when(F.col("id") % 3 == 1, F.col("id")).cast("int").alias("customer_id"),
        F.array(F.struct(F.lit(1).alias("item_id"), F.lit(False).alias("is_order"))).alias("impressions"),
    )
    clicks = spark.range(0, 1000).select(
        F.lit("2025-07-30").alias("dt"),
        F.col("id").cast("int").alias("customer_id"),
        F.lit(3).alias("item_id"),
        F.lit(datetime(2025, 7, 30, 10)).alias("click_time"),
    )
    small_partitions = {
        **NO_BROADCAST,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
    }
    with settings(spark, small_partitions):
        out = hindsight.build_training_inputs(impressions, clicks, carts, orders, max_seq=2)
        result = out.collect()
        assert len(result) == 40_000
        assert {tuple(r.actions) for r in result if r.customer_id == HOT} == {(3, 0)}
        assert "skew=true" in plan(out)


def test_rows_without_customer_are_spread(spark):
    from hindsight.operators import attach_by_customer_day

    rankings = spark.range(0, 1000, 1, 8).select(
        F.lit("2025-07-31").alias("dt"), F.lit(None).cast("int").alias("customer_id"), "id"
    )
    keyed = spark.createDataFrame([(1, 5, 9)], "customer_id int, day int, n int")
    with settings(spark, {**NO_BROADCAST, "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        joined = attach_by_customer_day(rankings, keyed)
        assert joined.where("n IS NULL").count() == 1000
        assert joined.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_long_sequences_above_the_rank_limit(spark):
    inputs = skewed(spark, 4)
    with pytest.warns(UserWarning, match="windowGroupLimitThreshold"):
        out = hindsight.build_training_inputs(*inputs, lookback_days=30, max_seq=1001)
    assert rows(out) == brute_force(*inputs, 30, 1001)


def test_activity_against_long_form(spark):
    inputs = skewed(spark, 5)
    entries = hindsight.history_entries(*inputs, lookback_days=30, max_seq=500)
    keys = ["dt", "ranking_id", "customer_id", "impression_item_id"]
    counted = entries.groupBy(*keys).agg(F.count("*").alias("n"))
    activity = hindsight.impression_activity(*inputs, lookback_days=30)
    # Repeated items of a ranking share their key here, so compare per distinct key.
    per_key = activity.groupBy(*keys).agg(F.sum("n_actions").alias("n"))
    assert rows(per_key.where("n > 0")) == rows(counted)


def test_uses_of_the_capped_actions_share_a_shuffle(spark):
    """Also with splits and a single log, where the optimizer drops the union of the logs."""
    from workloads.mappings import ORDERS_WINDOW, order_sources

    with settings(spark, {**NO_BROADCAST, "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64"}):
        out = hindsight.build_training_inputs(*order_sources(spark, "/root/testdata/sf0.001"), **ORDERS_WINDOW)
        text = plan(out)
    assert len(re.findall(r" Exchange hashpartitioning\(customer_id#\w+, day#\w+, _split#\w+, 64\)", text)) == 1
