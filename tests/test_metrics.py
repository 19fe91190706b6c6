"""Metrics, analytics, sinks and the job."""

import json
import os

import pytest

import hindsight
from hindsight import schema
from hindsight.plans.job import job_arguments

from .fixtures import SMALL_DAY, SMALL_EXPECTED, rows, small, write_small_csv


def inputs_of(spark, data):
    """Training inputs from (actions, action_types) pairs."""
    return spark.createDataFrame(
        [("2025-07-31", f"r{i}", i, 1, False, a, t) for i, (a, t) in enumerate(data)],
        schema.training_inputs_schema,
    )


@pytest.fixture
def golden(spark):
    return hindsight.build_training_inputs(*small(spark), max_seq=4)


def test_golden_metrics(golden):
    assert hindsight.calculate_dq_metrics(golden) == {
        "zero_history_pct": 0.0,
        "avg_history_length": 2.0,
        "action_type_distribution": {"0": 6 / 12, "1": 3 / 12, "2": 2 / 12, "3": 1 / 12},
    }
    assert hindsight.dq_summary(golden).first().asDict() == {
        "total_rows": 3, "bad_dt_rows": 0, "zero_history_pct": 0.0, "avg_history_length": 2.0
    }
    assert hindsight.sequence_length_distribution(golden) == {2: 3}
    assert hindsight.action_type_frequency_by_position(golden) == [
        {"1": 1.0}, {"2": 2 / 3, "3": 1 / 3}, {"0": 1.0}, {"0": 1.0}
    ]


def test_metrics_with_an_empty_history(spark):
    df = inputs_of(spark, [([101, 0, 0], [1, 0, 0]), ([0, 0, 0], [0, 0, 0])])
    metrics = hindsight.calculate_dq_metrics(df)
    assert metrics == {
        "zero_history_pct": 0.5,
        "avg_history_length": 0.5,
        "action_type_distribution": {"0": 5 / 6, "1": 1 / 6},
    }


def test_metrics_on_no_rows(spark):
    df = inputs_of(spark, [])
    assert hindsight.calculate_dq_metrics(df) == {
        "zero_history_pct": None, "avg_history_length": None, "action_type_distribution": {}
    }
    summary = hindsight.dq_summary(df).first()
    assert (summary.total_rows, summary.zero_history_pct, summary.avg_history_length) == (0, None, None)
    assert hindsight.action_type_distribution(df).collect() == []
    assert hindsight.sequence_length_distribution(df) == {}
    assert hindsight.action_type_frequency_by_position(df) == []


def test_history_length_counts_what_is_neither_null_nor_zero(spark):
    df = inputs_of(spark, [([-5, 0], [1, 0]), ([None, 0], [1, 0]), ([], []), ([7, 8], [2, 2])])
    assert hindsight.sequence_length_distribution(df) == {1: 1, 0: 2, 2: 1}
    summary = hindsight.dq_summary(df).first()
    assert (summary.zero_history_pct, summary.avg_history_length) == (0.5, 0.75)
    assert hindsight.calculate_dq_metrics(df) == {
        "zero_history_pct": 0.5,
        "avg_history_length": 0.75,
        "action_type_distribution": {"0": 2 / 6, "1": 2 / 6, "2": 2 / 6},
    }


def test_zeros_between_entries_and_unknown_codes(spark):
    df = inputs_of(spark, [([1, 0, 2], [9, 0, 1]), ([1, 2, 3], [9, 9, 9])])
    shares = {r.action_type: (r.n, r.share) for r in hindsight.action_type_distribution(df).collect()}
    assert shares == {0: (1, 1 / 6), 1: (1, 1 / 6), 9: (4, 4 / 6)}
    assert hindsight.calculate_dq_metrics(df)["action_type_distribution"] == {"0": 1 / 6, "1": 1 / 6, "9": 4 / 6}


def test_positions_are_limited_to_the_longest_array(spark):
    df = inputs_of(spark, [([1, 2], [1, 2]), ([1], [3])])
    assert hindsight.action_type_frequency_by_position(df, max_positions=5) == [{"1": 0.5, "3": 0.5}, {"2": 1.0}]
    assert hindsight.action_type_frequency_by_position(df, max_positions=1) == [{"1": 0.5, "3": 0.5}]
    with pytest.raises(ValueError, match="max_positions"):
        hindsight.action_types_by_position(df, 0)


def test_metrics_need_only_their_columns(golden):
    assert hindsight.calculate_dq_metrics(golden.select("actions", "action_types"))["avg_history_length"] == 2.0
    with pytest.raises(ValueError, match="missing columns"):
        hindsight.sequence_lengths(golden.drop("actions"))


def test_parquet_sink(spark, golden, tmp_path):
    path = str(tmp_path / "out")
    hindsight.save_training_inputs(golden, path)
    assert rows(spark.read.parquet(path)) == sorted(SMALL_EXPECTED, key=repr)
    hindsight.save_training_inputs(golden, path, mode="append")
    assert spark.read.parquet(path).count() == 6
    hindsight.save_training_inputs(golden, path)
    assert spark.read.parquet(path).count() == 3
    hindsight.save_training_inputs(golden, str(tmp_path / "by_day"), partition_by=["dt"])
    assert os.path.isdir(tmp_path / "by_day" / f"dt={SMALL_DAY}")


@pytest.mark.parametrize("source_format", ["csv", "parquet"])
def test_job(spark, tmp_path, source_format):
    paths = write_small_csv(tmp_path)
    if source_format == "parquet":
        for name, df in hindsight.load_sources(spark, paths)._asdict().items():
            df.write.parquet(str(tmp_path / name))
        paths = hindsight.SourcePaths(*[str(tmp_path / name) for name in hindsight.SourcePaths._fields])
    names = ("spark.sql.session.timeZone", "spark.sql.optimizer.windowGroupLimitThreshold")
    before = [spark.conf.get(name) for name in names]
    written = hindsight.run_job(
        spark,
        paths,
        str(tmp_path / "output"),
        max_seq=4,
        metrics_path=str(tmp_path / "metrics"),
        source_format=source_format,
    )
    assert rows(written) == sorted(SMALL_EXPECTED, key=repr)
    assert [spark.conf.get(name) for name in names] == before
    (file,) = [f for f in os.listdir(tmp_path / "metrics") if f.endswith(".json")]
    metrics = json.loads((tmp_path / "metrics" / file).read_text())
    assert metrics == {
        "total_rows": 3,
        "bad_dt_rows": 0,
        "zero_history_pct": 0.0,
        "avg_history_length": 2.0,
        "action_type_distribution": {"0": 0.5, "1": 0.25, "2": 2 / 12, "3": 1 / 12},
    }


def test_job_arguments():
    required = ["--impressions", "i", "--clicks", "c", "--add_to_carts", "a", "--previous_orders", "p"]
    args = job_arguments([*required, "--output", "/out"])
    assert (args.output, args.lookback_days, args.max_seq, args.metrics_json) == ("/out", 365, 1000, None)
    assert args.partition_by == []
    assert job_arguments([*required, "--output", "o", "--partition_by", "dt"]).partition_by == ["dt"]
    with pytest.raises(SystemExit):
        job_arguments(required)


def test_job_gives_settings_back_when_it_fails(spark, tmp_path):
    spark.conf.set("spark.sql.session.timeZone", "Europe/Madrid")
    try:
        with pytest.raises(Exception):
            hindsight.run_job(spark, hindsight.SourcePaths(*4 * [str(tmp_path / "none")]), str(tmp_path / "o"), max_seq=5000)
        assert spark.conf.get("spark.sql.session.timeZone") == "Europe/Madrid"
        assert spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold") == "1000"
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_unknown_source_format():
    with pytest.raises(ValueError, match="source_format"):
        hindsight.load_sources(None, None, "orc")
