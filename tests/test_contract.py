"""One test per decision of the data contract."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import hindsight
from hindsight import schema

from .fixtures import (
    SMALL_CSV,
    SMALL_EXPECTED,
    brute_force,
    cart,
    click,
    medium,
    order,
    ranking,
    rows,
    small,
    sources,
    write_small_csv,
)

COLUMNS = ["dt", "ranking_id", "customer_id", "impression_item_id", "is_order", "actions", "action_types"]


def one_history(spark, clicks=(), carts=(), orders=(), **window):
    """Actions and types for a single impression of customer 1 on 2025-07-31."""
    inputs = sources(spark, [ranking("2025-07-31", "r", 1, (9, False))], clicks, carts, orders)
    row = hindsight.build_training_inputs(*inputs, **{"max_seq": 4, **window}).first()
    return row.actions, row.action_types


def test_end_to_end_from_csv(spark, tmp_path):
    out = hindsight.build_training_inputs(
        *hindsight.load_sources(spark, write_small_csv(tmp_path)), lookback_days=365, max_seq=4
    )
    assert out.columns == COLUMNS
    assert out.schema["actions"].dataType == T.ArrayType(T.IntegerType())
    assert out.schema["action_types"].dataType == T.ArrayType(T.ByteType())
    assert rows(out) == sorted(SMALL_EXPECTED, key=repr)


def test_csv_with_reordered_header_fails(spark, tmp_path):
    path = tmp_path / "clicks.csv"
    path.write_text("dt,item_id,customer_id,click_time\n2025-07-30,44,1,2025-07-30 10:00:00\n")
    with pytest.raises(Exception, match="does not conform to the schema"):
        hindsight.read_csv_with_schema(spark, str(path), schema.clicks_schema).collect()
    with pytest.raises(Exception, match="does not conform to the schema"):
        hindsight.count_bad_rows(spark, str(path), schema.clicks_schema).collect()


def test_bad_cells_become_null_and_are_counted(spark, tmp_path):
    path = tmp_path / "clicks.csv"
    path.write_text(SMALL_CSV["clicks"] + "2025-07-30,x,5,2025-07-30 10:00:00\n2025-07-30,3,5,soon\n")
    scanned = hindsight.read_csv_with_schema(spark, str(path), schema.clicks_schema)
    assert scanned.where("customer_id IS NULL OR click_time IS NULL").count() == 2
    counted = hindsight.count_bad_rows(spark, str(path), schema.clicks_schema).first().asDict()
    assert counted == {
        "total_rows": 4,
        "bad_rows": 2,
        "null_dt": 0,
        "null_customer_id": 1,
        "null_item_id": 0,
        "null_click_time": 1,
    }


def test_impressions_json_branches(spark):
    text = spark.createDataFrame(
        [(1, '[{"item_id":1,"is_order":true}]'), (2, "[]"), (3, "nope"), (4, None), (5, '[{"item_id":"x"}]')],
        "id int, impressions string",
    )
    parsed = hindsight.coerce_impressions_from_json(text).orderBy("id").collect()
    assert [r.impressions and [tuple(s) for s in r.impressions] for r in parsed] == [
        [(1, True)], [], None, None, [(None, None)]
    ]
    assert hindsight.coerce_impressions_from_json(text.select("id")).columns == ["id"]
    nested = spark.createDataFrame([], schema.impressions_schema)
    assert hindsight.coerce_impressions_from_json(nested) is nested


def test_impression_without_history_is_kept_as_padding(spark):
    assert one_history(spark) == ([0] * 4, [0] * 4)
    assert one_history(spark, [click(2, 5, "2025-07-30 10:00:00")]) == ([0] * 4, [0] * 4)


def test_null_and_empty_rankings_keep_a_row(spark):
    inputs = sources(
        spark, [("2025-07-31", "r1", 1, None), ("2025-07-31", "r2", 1, [])], [click(1, 5, "2025-07-30 10:00:00")]
    )
    assert rows(hindsight.build_training_inputs(*inputs, max_seq=2)) == [
        ("2025-07-31", "r1", 1, None, None, [5, 0], [1, 0]),
        ("2025-07-31", "r2", 1, None, None, [5, 0], [1, 0]),
    ]
    assert hindsight.explode_impressions(inputs[0]).columns == COLUMNS[:5]


def test_window_bounds(spark):
    clicks = [
        click(1, 1, "2025-07-31 00:00:00"),  # midnight of dt: out
        click(1, 2, "2025-07-30 23:59:59.999999"),
        click(1, 3, "2025-07-24 00:00:00"),  # exactly seven days before: in
        click(1, 4, "2025-07-23 23:59:59.999999"),
        click(1, 5, "2025-07-31 10:00:00"),  # same day
    ]
    assert one_history(spark, clicks, lookback_days=7) == ([2, 3, 0, 0], [1, 1, 0, 0])
    assert one_history(spark, clicks, lookback_days=0) == ([0] * 4, [0] * 4)


def test_order_and_truncation_keep_the_newest(spark):
    clicks = [click(1, i, f"2025-07-{i:02d} 10:00:00") for i in range(1, 31)]
    assert one_history(spark, clicks)[0] == [30, 29, 28, 27]
    assert one_history(spark, clicks, order="oldest_first")[0] == [27, 28, 29, 30]
    few = clicks[:2]
    assert one_history(spark, few, order="oldest_first")[0] == [1, 2, 0, 0]


def test_repeated_items_stay_separate(spark):
    inputs = sources(
        spark,
        [ranking("2025-07-31", "r", 1, (7, False), (7, False), (7, True))],
        [click(1, 5, "2025-07-30 10:00:00"), click(1, 6, "2025-07-29 10:00:00")],
    )
    assert rows(hindsight.build_training_inputs(*inputs, max_seq=3)) == [
        ("2025-07-31", "r", 1, 7, False, [5, 6, 0], [1, 1, 0]),
        ("2025-07-31", "r", 1, 7, False, [5, 6, 0], [1, 1, 0]),
        ("2025-07-31", "r", 1, 7, True, [5, 6, 0], [1, 1, 0]),
    ]


def test_ties_are_broken_by_type_then_item(spark):
    at = "2025-07-30 00:00:00"
    assert one_history(
        spark, [click(1, 8, at)], [cart(1, 3, at), cart(1, 4, at)], [order(1, 1, at[:10])]
    ) == ([1, 4, 3, 8], [3, 2, 2, 1])


def test_duplicate_actions_are_kept(spark):
    twice = [click(1, 8, "2025-07-30 10:00:00")] * 2
    assert one_history(spark, twice) == ([8, 8, 0, 0], [1, 1, 0, 0])


def test_null_values(spark):
    clicks = [click(1, None, "2025-07-30 10:00:00"), click(1, 5, None), click(None, 6, "2025-07-30 10:00:00")]
    assert one_history(spark, clicks) == ([None, 0, 0, 0], [1, 0, 0, 0])
    inputs = sources(spark, [ranking("2025-07-31", "r", None, (9, False))], clicks)
    assert hindsight.build_training_inputs(*inputs, max_seq=2).first().actions == [0, 0]


def test_malformed_dt_gives_empty_history_and_is_counted(spark):
    inputs = sources(
        spark,
        [ranking("31/07/2025", "r1", 1, (9, False)), ranking(None, "r2", 1, (9, False))],
        [click(1, 5, "2025-07-30 10:00:00")],
    )
    out = hindsight.build_training_inputs(*inputs, max_seq=2)
    assert [r.actions for r in out.collect()] == [[0, 0], [0, 0]]
    assert hindsight.dq_summary(out).first().bad_dt_rows == 2
    pruned = hindsight.prune_logs(*inputs, lookback_days=365)
    assert [log.count() for log in pruned] == [0, 0, 0]


def test_zoneless_timestamps_give_the_same(spark):
    impressions, clicks, carts, orders = small(spark)
    clicks = clicks.withColumn("click_time", F.col("click_time").cast("timestamp_ntz"))
    carts = carts.withColumn("occurred_at", F.col("occurred_at").cast("timestamp_ntz"))
    actions = hindsight.normalize_actions(clicks, carts, orders)
    assert actions.schema["ts"].dataType == T.TimestampNTZType()
    out = hindsight.build_training_inputs(impressions, clicks, carts, orders, max_seq=4)
    assert rows(out) == sorted(SMALL_EXPECTED, key=repr)


def test_days_are_calendar_days_of_the_session_zone(spark):
    # The night to 2025-03-30 is an hour short in Berlin; the window still opens at a midnight.
    zone = spark.conf.get("spark.sql.session.timeZone")
    texts = ["2025-03-28 23:59:59", "2025-03-29 00:00:00", "2025-03-30 23:59:59", "2025-03-31 00:00:00"]
    try:
        spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
        empty = sources(spark, [ranking("2025-03-31", "r", 1, (9, False))])
        clicks = spark.createDataFrame(
            [(t[:10], 1, i, t) for i, t in enumerate(texts, 1)], "dt string, customer_id int, item_id int, t string"
        )
        for ts_type in ("timestamp", "timestamp_ntz"):
            typed = clicks.withColumn("click_time", F.col("t").cast(ts_type))
            pruned = hindsight.prune_logs(empty[0], typed, *empty[2:], lookback_days=2)
            for log in (typed, pruned[0]):
                out = hindsight.build_training_inputs(empty[0], log, *empty[2:], lookback_days=2, max_seq=4)
                assert out.first().actions == [3, 2, 0, 0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_normalized_actions(spark):
    actions = hindsight.normalize_actions(*small(spark)[1:])
    assert actions.schema["action_type"].dataType == T.ByteType()
    assert actions.columns == ["customer_id", "item_id", "ts", "action_type"]
    assert rows(actions.where("customer_id = 11")) == sorted(
        [
            (11, 7, datetime(2023, 3, 14, 8, 15, 30), 1),
            (11, 8, datetime(2023, 3, 10, 17, 5), 2),
            (11, 5, datetime(2022, 3, 14), 3),
        ],
        key=repr,
    )


@pytest.mark.parametrize(
    "window",
    [
        {"max_seq": 0}, {"max_seq": -1}, {"max_seq": 1.5}, {"max_seq": True}, {"max_seq": "3"}, {"max_seq": None},
        {"lookback_days": -1}, {"lookback_days": False}, {"lookback_days": float("inf")}, {"order": "random"},
    ],
)
def test_invalid_parameters(spark, window):
    with pytest.raises(ValueError, match=next(iter(window))):
        hindsight.build_training_inputs(*small(spark), **window)
    if "order" not in window:
        with pytest.raises(ValueError, match=next(iter(window))):
            hindsight.history_entries(*small(spark), **window)


def test_whole_floats_are_integers(spark):
    exact = hindsight.build_training_inputs(*small(spark), lookback_days=365, max_seq=4)
    assert rows(hindsight.build_training_inputs(*small(spark), lookback_days=365.0, max_seq=4.0)) == rows(exact)


@pytest.mark.parametrize(
    "dt", ["2025", "2025-07", "2025-7-31", " 2025-07-31 ", "2025-07-31 13:00:00", "2025-07-31T13:00", "2025-02-30", "", None]
)
def test_only_days_written_as_days_count(spark, dt):
    impressions, *logs = sources(spark, [ranking(dt, "r", 1, (9, False))], [click(1, 3, "2024-12-31 10:00:00"), click(1, 4, "2025-07-30 10:00:00")])
    out = hindsight.build_training_inputs(impressions, *logs, max_seq=2)
    assert out.first().actions == [0, 0]
    assert hindsight.dq_summary(out).first().bad_dt_rows == 1
    assert [log.count() for log in hindsight.prune_logs(impressions, *logs, lookback_days=9)] == [0, 0, 0]
    day = impressions.withColumn("dt", F.lit("2025-07-31").cast("date"))
    assert hindsight.build_training_inputs(day, *logs, max_seq=2).first().actions == [4, 3]


def test_missing_and_mistyped_columns(spark):
    impressions, clicks, carts, orders = small(spark)
    with pytest.raises(ValueError, match=r"clicks_df is missing columns: \['click_time'\]"):
        hindsight.normalize_actions(clicks.drop("click_time"), carts, orders)
    with pytest.raises(ValueError, match="impressions_df is missing columns"):
        hindsight.explode_impressions(impressions.drop("ranking_id", "dt"))
    with pytest.raises(ValueError, match="unexpected type"):
        hindsight.normalize_actions(clicks, carts, orders.withColumn("order_date", F.lit("2025-01-01")))
    with pytest.raises(ValueError, match="unexpected type"):
        hindsight.explode_impressions(impressions.withColumn("impressions", F.lit("[]")))


def test_customer_ids_of_other_kinds(spark):
    impressions, clicks, carts, orders = small(spark)
    wide = impressions.withColumn("customer_id", F.col("customer_id").cast("bigint"))
    assert rows(hindsight.build_training_inputs(wide, clicks, carts, orders, max_seq=4)) == sorted(
        SMALL_EXPECTED, key=repr
    )
    text = [df.withColumn("customer_id", F.col("customer_id").cast("string")) for df in small(spark)]
    out = hindsight.build_training_inputs(*text, max_seq=4)
    assert rows(out) == sorted([(d, r, str(c), *rest) for d, r, c, *rest in SMALL_EXPECTED], key=repr)
    with pytest.raises(ValueError, match="customer_id differs in type"):
        hindsight.build_training_inputs(text[0], clicks, carts, orders)
    with pytest.raises(ValueError, match="customer_id differs in type"):
        hindsight.normalize_actions(text[1], carts, orders)


def test_streams_are_refused(spark, tmp_path):
    impressions, clicks, carts, orders = small(spark)
    stream = spark.readStream.schema(schema.clicks_schema).parquet(str(tmp_path))
    with pytest.raises(ValueError, match="streaming"):
        hindsight.build_training_inputs(impressions, stream, carts, orders)
    inputs = spark.readStream.schema(schema.training_inputs_schema).parquet(str(tmp_path))
    for function in (
        hindsight.calculate_dq_metrics,
        hindsight.sequence_length_distribution,
        hindsight.action_type_frequency_by_position,
    ):
        with pytest.raises(ValueError, match="streaming"):
            function(inputs)


def test_medium_fixture_against_brute_force(spark):
    inputs = medium(spark)
    out = hindsight.build_training_inputs(*inputs, lookback_days=365, max_seq=10)
    assert rows(out) == brute_force(*inputs, 365, 10)
    inside = inputs[3].where("order_date >= '2022-02-20' and order_date < '2023-02-20'").count()
    assert 0 < inside < inputs[3].count()


def test_without_ansi_mode(spark):
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    try:
        spark.conf.set("spark.sql.ansi.enabled", "false")
        out = hindsight.build_training_inputs(*small(spark), max_seq=4)
        assert rows(out) == sorted(SMALL_EXPECTED, key=repr)
        nothing = spark.createDataFrame([("bad", "r", 1, 1, False, None, None)], schema.training_inputs_schema)
        metrics = hindsight.dq_metrics(out.unionByName(nothing)).first()
        assert metrics.asDict() == {
            "total_rows": 4,
            "bad_dt_rows": 1,
            "zero_history_pct": 0.0,
            "avg_history_length": 2.0,
            "action_type_distribution": {"0": 6 / 12, "1": 3 / 12, "2": 2 / 12, "3": 1 / 12},
        }
    finally:
        spark.conf.set("spark.sql.ansi.enabled", ansi)


def test_pruned_logs_give_the_same_result(spark):
    impressions, *logs = medium(spark)
    impressions = impressions.where("customer_id % 3 = 0")
    pruned = hindsight.prune_logs(impressions, *logs, lookback_days=20)
    assert [log.count() < whole.count() for log, whole in zip(pruned, logs)] == [True, True, True]
    first, last = datetime(2023, 1, 31), datetime(2023, 2, 20)
    kept = [r.click_time for r in pruned[0].collect()]
    assert sorted(kept) == sorted(r.click_time for r in logs[0].collect() if first <= r.click_time < last)
    expected = brute_force(impressions, *logs, 20, 5)
    assert rows(hindsight.build_training_inputs(impressions, *pruned, lookback_days=20, max_seq=5)) == expected
    assert rows(hindsight.build_training_inputs(impressions, *logs, lookback_days=20, max_seq=5)) == expected


def test_time_bounds_reach_the_scan(spark, tmp_path):
    impressions, clicks, carts, orders = medium(spark)
    clicks.write.parquet(str(tmp_path / "clicks"))
    scanned = spark.read.parquet(str(tmp_path / "clicks"))
    (pruned, *_) = hindsight.prune_logs(impressions, scanned, carts, orders, lookback_days=20)
    text = pruned._jdf.queryExecution().executedPlan().toString()
    filters = text.split("DataFilters: ")[1].split("Format")[0]
    assert "click_time" in filters and "subquery" in filters


def test_exports():
    for name in hindsight.__all__:
        assert hasattr(hindsight, name)
    assert (hindsight.constants.DEFAULT_LOOKBACK_DAYS, hindsight.constants.DEFAULT_MAX_SEQ) == (365, 1000)
