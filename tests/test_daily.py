"""Stored days, reruns of days, metrics by day, observed metrics and rejects."""

import json
import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

import hindsight
from hindsight import schema
from hindsight.plans.job import job_arguments

from .fixtures import SMALL_EXPECTED, brute_force, rows, small, write_small_csv
from .test_metrics import inputs_of
from .test_scale import HOT, plan, skewed

FIRST = date(2024, 12, 25)
LAST = date(2025, 3, 10)


@pytest.mark.parametrize("lookback_days, max_seq", [(7, 3), (365, 17), (0, 2)])
def test_stored_days_equal_raw_logs(spark, tmp_path, lookback_days, max_seq):
    impressions, *logs = skewed(spark, 11)
    path, day = str(tmp_path), FIRST
    while day <= LAST:
        upto = min(day + timedelta(days=19), LAST)
        hindsight.save_action_days(*logs, path, day, upto, max_seq=max_seq)
        day = upto + timedelta(days=1)
    stored = hindsight.load_action_days(spark, path, max_seq=max_seq)
    out = hindsight.build_training_inputs_from_days(impressions, stored, lookback_days=lookback_days, max_seq=max_seq)
    assert rows(out) == brute_force(impressions, *logs, lookback_days, max_seq)


def test_a_day_is_stored_again(spark, tmp_path):
    impressions, clicks, carts, orders = skewed(spark, 12)
    path, hot_day = str(tmp_path), date(2025, 1, 21)
    wrong = clicks.withColumn("item_id", F.lit(99))
    hindsight.save_action_days(wrong, carts, orders, path, FIRST, LAST, max_seq=5)
    # A day after the other, and a second time: what is stored is what was stored last.
    for first, last in ((FIRST, hot_day), (hot_day, LAST), (hot_day, hot_day)):
        hindsight.save_action_days(clicks, carts, orders, path, first, last, max_seq=5)
    stored = hindsight.load_action_days(spark, path, max_seq=5)
    assert stored.where("item_id = 99").count() == 0
    out = hindsight.build_training_inputs_from_days(impressions, stored, lookback_days=60, max_seq=5)
    assert rows(out) == brute_force(impressions, clicks, carts, orders, 60, 5)


def test_a_day_without_actions_replaces_what_was_there(spark, tmp_path):
    _, clicks, carts, orders = skewed(spark, 13)
    day = date(2025, 1, 21)
    hindsight.save_action_days(clicks, carts, orders, str(tmp_path), day, day, max_seq=5)
    assert hindsight.load_action_days(spark, str(tmp_path), max_seq=5).count() > 0
    nothing = [log.where(F.lit(False)) for log in (clicks, carts, orders)]
    hindsight.save_action_days(*nothing, str(tmp_path), day, day, max_seq=5)
    assert hindsight.load_action_days(spark, str(tmp_path), max_seq=5).count() == 0


def test_stored_days_are_capped_and_pruned(spark, tmp_path):
    impressions, *logs = skewed(spark, 14)
    hindsight.save_action_days(*logs, str(tmp_path), FIRST, LAST, max_seq=4)
    stored = hindsight.load_action_days(spark, str(tmp_path), max_seq=4)
    per_day = stored.groupBy("customer_id", "action_day").count()
    assert per_day.agg(F.max("count")).head()[0] == 4
    assert stored.where(F.col("customer_id") == HOT).count() > 0
    out = hindsight.build_training_inputs_from_days(impressions.where("dt = '2025-01-30'"), stored, lookback_days=3, max_seq=4)
    out.collect()
    assert "PartitionFilters: [isnotnull(action_day" in plan(out)


def test_states_of_other_caps_are_not_mixed_up(spark, tmp_path):
    _, *logs = skewed(spark, 15)
    hindsight.save_action_days(*logs, str(tmp_path), FIRST, FIRST, max_seq=4)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        hindsight.load_action_days(spark, str(tmp_path), max_seq=5).count()


@pytest.mark.parametrize("first, last", [(LAST, FIRST), ("2025-01-01", LAST), (datetime(2025, 1, 1), LAST), (None, LAST)])
def test_days_are_checked(spark, tmp_path, first, last):
    with pytest.raises(ValueError, match="dates in order"):
        hindsight.save_action_days(*skewed(spark, 1)[1:], str(tmp_path), first, last)


def test_rerun_of_a_partition(spark, tmp_path):
    def frame(dt, n):
        return inputs_of(spark, [([i], [1]) for i in range(n)]).withColumn("dt", F.lit(dt))

    path = str(tmp_path / "out")
    hindsight.save_training_inputs(frame("2025-01-01", 2).unionByName(frame("2025-01-02", 3)), path, partition_by=["dt"])
    for _ in range(2):
        hindsight.save_training_inputs(frame("2025-01-02", 5), path, partition_by=["dt"], replace="partitions")
    counts = {str(r.dt): r["count"] for r in spark.read.parquet(path).groupBy("dt").count().collect()}
    assert counts == {"2025-01-01": 2, "2025-01-02": 5}
    # The session's own mode does not change what "all" means.
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        hindsight.save_training_inputs(frame("2025-01-02", 1), path, partition_by=["dt"])
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert spark.read.parquet(path).count() == 1
    for wrong in ({"replace": "partitions"}, {"replace": "days"}, {"replace": "partitions", "mode": "append", "partition_by": ["dt"]}):
        with pytest.raises(ValueError):
            hindsight.save_training_inputs(frame("2025-01-02", 1), path, **wrong)


def _job(spark, tmp_path, **options):
    paths = hindsight.SourcePaths(*write_small_csv(tmp_path))
    return hindsight.run_job(spark, paths, str(tmp_path / "out"), max_seq=4, **options)


def _read_json(path):
    lines = [line for f in os.listdir(path) if f.endswith(".json") for line in open(os.path.join(path, f))]
    return [json.loads(line) for line in lines]


def test_job_metrics_are_observed(spark, tmp_path):
    out = _job(spark, tmp_path, metrics_path=str(tmp_path / "metrics"))
    assert sorted(map(str, rows(out))) == sorted(map(str, SMALL_EXPECTED))
    (observed,) = _read_json(tmp_path / "metrics")
    assert observed == hindsight.dq_metrics(out).toPandas().to_dict("records")[0]
    _job(spark, tmp_path, metrics_path=str(tmp_path / "metrics"), rejects_path=str(tmp_path / "rejects"))
    assert _read_json(tmp_path / "metrics") == [{**observed, "bad_impressions_rows": 0}]


def test_metrics_cost_no_second_scan(spark, tmp_path, monkeypatch):
    from hindsight.plans import quality

    monkeypatch.setattr(quality, "dq_metrics", None)
    tracker = spark.sparkContext.statusTracker()

    def jobs(group, **options):
        spark.sparkContext.setJobGroup(group, group)
        _job(spark, tmp_path, **options)
        return len(tracker.getJobIdsForGroup(group))

    plain = jobs("plain")
    # One more job writes the metrics' single row.
    assert jobs("with-metrics", metrics_path=str(tmp_path / "metrics")) <= plain + 1


def test_observed_metrics_equal_dq_metrics(spark, tmp_path):
    from pyspark.sql import Observation

    from hindsight.plans.quality import observed, observed_metrics

    for data in ([], [([1, 0, None], [1, 0, 2]), ([0, 0], [0, 0]), (None, None), ([5], [None])]):
        df = inputs_of(spark, data).withColumn("dt", F.when(F.col("ranking_id") == "r1", "bad").otherwise("2025-01-01"))
        observation = Observation()
        observed(df, observation).write.mode("overwrite").parquet(str(tmp_path / "x"))
        told = observed_metrics(spark, observation).first().asDict()
        expected = hindsight.dq_metrics(df).first().asDict()
        shares, known = told.pop("action_type_distribution"), expected.pop("action_type_distribution")
        assert told == expected
        assert {k: v for k, v in shares.items() if k != "other"} == {k: v for k, v in known.items() if k != "None"}
        assert shares.get("other", 0) == known.get("None", 0)


BAD_JSON = ["not json", '{"item_id": 1}', '[{"item_id": 1}', '[{"item_id": "x", "is_order": true}]', "[1]", "[]]", ""]
GOOD_JSON = ["[]", '[{"item_id": 1, "is_order": true}]', '[{"item_id": 1}]', "[{}]", "[null]", None]


def test_rejected_json(spark):
    rankings = [("2025-01-01", f"r{i}", i, text) for i, text in enumerate(BAD_JSON + GOOD_JSON)]
    df = spark.createDataFrame(rankings, "dt string, ranking_id string, customer_id int, impressions string")
    plainly = hindsight.coerce_impressions_from_json(df)
    flagged = hindsight.coerce_impressions_from_json(df, flag="bad_impressions")
    assert rows(flagged.drop("bad_impressions")) == rows(plainly)
    rejects = hindsight.bad_impressions(df).collect()
    told = {r.ranking_id for r in flagged.where("bad_impressions").collect()}
    assert {r.ranking_id for r in rejects} == told
    known = {f"r{i}" for i in range(len(BAD_JSON))}
    # Trailing text is where the parser stops reading, and empty text is its null.
    assert known - told <= {"r5"} and told <= known
    nothing = small(spark)[1:]
    summary = hindsight.dq_summary(hindsight.build_training_inputs(flagged, *nothing, max_seq=4)).first()
    assert summary.bad_impressions_rows == len(told) and summary.total_rows == len(rankings)


def test_csv_rejects(spark, tmp_path):
    lines = ["dt,customer_id,item_id,click_time", "2025-01-01,1,2,2025-01-01 10:00:00", "2025-01-01,x,2,noon", "2025-01-02,1"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text(lines[0] + "\n,,,\n")
    found = {r.line: r for r in hindsight.csv_rejects(spark, str(tmp_path), schema.clicks_schema).collect()}
    assert set(found) == set(lines[2:])
    assert found[lines[2]].null_cells == ["customer_id", "click_time"]
    assert all(r.file.endswith("a.csv") and r.block_start == 0 for r in found.values())
    assert hindsight.count_bad_rows(spark, str(tmp_path), schema.clicks_schema).first().bad_rows == len(found)


def test_job_keeps_rejects(spark, tmp_path):
    paths = hindsight.SourcePaths(*write_small_csv(tmp_path))
    os.makedirs(tmp_path / "odd")
    (tmp_path / "odd" / "clicks.csv").write_text("dt,customer_id,item_id,click_time\n2025-01-01,1,two,2025-01-01 10:00:00\n")
    hindsight.run_job(
        spark, paths._replace(clicks=str(tmp_path / "odd")), str(tmp_path / "out"), max_seq=4, rejects_path=str(tmp_path / "rejects")
    )
    kept = {name: spark.read.parquet(str(tmp_path / "rejects" / name)).count() for name in paths._fields}
    assert spark.read.parquet(str(tmp_path / "rejects" / "impressions_json")).count() == 0
    assert kept == {"impressions": 0, "clicks": 1, "add_to_carts": 0, "previous_orders": 0}
    with pytest.raises(ValueError, match="only CSV"):
        hindsight.run_job(spark, paths, str(tmp_path / "out"), source_format="parquet", rejects_path="x")


def test_new_job_options():
    required = [x for name in ("impressions", "clicks", "add_to_carts", "previous_orders", "output") for x in (f"--{name}", "p")]
    assert (job_arguments(required).replace, job_arguments(required).rejects) == ("all", None)
    given = job_arguments([*required, "--replace", "partitions", "--rejects", "r"])
    assert (given.replace, given.rejects) == ("partitions", "r")


def test_merged_days_equal_one_pass(spark):
    data = [([1, 2, 0], [1, 3, 0]), ([0, 0, 0], [0, 0, 0]), (None, None), ([4], [7]), ([None, 5], [None, 2]), ([], [])] * 4
    df = inputs_of(spark, data).withColumn("dt", F.element_at(F.array(*map(F.lit, ["2025-01-01", "2025-01-02", "2025", None])), F.col("customer_id") % 4 + 1))
    parts = [hindsight.metrics_by_day(df.where(F.col("customer_id") % 3 == i), max_positions=2) for i in range(3)]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert rows(hindsight.merged_sequence_lengths(merged)) == rows(hindsight.sequence_lengths(df))
    assert rows(hindsight.merged_action_types(merged)) == rows(hindsight.action_type_distribution(df))
    assert rows(hindsight.merged_types_by_position(merged)) == rows(hindsight.action_types_by_position(df, 2))
    assert rows(hindsight.merged_summary(merged)) == rows(hindsight.dq_summary(df))
    nothing = merged.where(F.lit(False))
    assert rows(hindsight.merged_summary(nothing)) == rows(hindsight.dq_summary(df.where(F.lit(False))))
