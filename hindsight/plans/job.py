"""The batch job: four datasets in, Parquet training inputs and optional JSON metrics out."""

import argparse
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession

from .. import schema
from ..constants import COL_BAD_IMPRESSIONS, DEFAULT_LOOKBACK_DAYS, DEFAULT_MAX_SEQ
from ..operators.history import check_window
from ..sources import (
    SourcePaths,
    bad_impressions,
    csv_rejects,
    load_sources,
    read_csv_with_schema,
    save_metrics,
    save_training_inputs,
)
from .quality import observed, observed_metrics
from .training_inputs import MAP_SIDE_RANK_LIMIT, build_training_inputs

# Option names and defaults below are fixed values of the contract.


@contextmanager
def _settings(spark: SparkSession, max_seq: int) -> Iterator[None]:
    """UTC days and a rank limit for ``max_seq``; what was set before comes back."""
    limit = max(max_seq, int(spark.conf.get(MAP_SIDE_RANK_LIMIT)))
    wanted = {"spark.sql.session.timeZone": "UTC", MAP_SIDE_RANK_LIMIT: str(limit)}
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def run_job(
    spark: SparkSession,
    paths: SourcePaths,
    output: str,
    lookback_days: int = DEFAULT_LOOKBACK_DAYS,
    max_seq: int = DEFAULT_MAX_SEQ,
    metrics_path: str | None = None,
    source_format: str = "csv",
    partition_by: Sequence[str] = (),
    replace: str = "all",
    rejects_path: str | None = None,
) -> DataFrame:
    """Build and write the training inputs, and return them as read back from ``output``.

    Metrics are observed in the pass that writes. ``replace="partitions"`` leaves partitions that the run has no
    rows for. With ``rejects_path``, lines of CSV sources that do not parse are kept under it, a folder for each
    dataset, and rankings whose impressions are no JSON in ``impressions_json``; metrics count these, too. The job runs in
    UTC, so days and midnights mean the same on every cluster; the session's own settings are as
    before when it returns.
    """
    lookback_days, max_seq = check_window(lookback_days, max_seq)
    with _settings(spark, max_seq):
        if rejects_path:
            _save_rejects(spark, paths, source_format, rejects_path)
        sources = load_sources(spark, paths, source_format, flag=COL_BAD_IMPRESSIONS if rejects_path else None)
        train = build_training_inputs(*sources, lookback_days=lookback_days, max_seq=max_seq)
        metrics = Observation()
        if metrics_path:
            train = observed(train, metrics)
        train = train.drop(COL_BAD_IMPRESSIONS)
        save_training_inputs(train, output, partition_by=partition_by, replace=replace)
        if metrics_path:
            save_metrics(observed_metrics(spark, metrics), metrics_path)
        return spark.read.schema(train.schema).parquet(output)


def _save_rejects(spark: SparkSession, paths: SourcePaths, source_format: str, rejects_path: str) -> None:
    if source_format != "csv":
        raise ValueError(f"only CSV sources have lines to reject, not {source_format!r}")
    for dataset, path in paths._asdict().items():
        rejects = csv_rejects(spark, path, getattr(schema, f"{dataset}_schema"))
        rejects.write.mode("overwrite").parquet(f"{rejects_path}/{dataset}")
    rankings = read_csv_with_schema(spark, paths.impressions, schema.impressions_schema)
    bad_impressions(rankings).write.mode("overwrite").parquet(f"{rejects_path}/impressions_json")


def job_arguments(argv: Sequence[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(description="Build training inputs from impressions and action logs")
    for dataset in SourcePaths._fields:
        parser.add_argument(f"--{dataset}", required=True, help=f"path of the {dataset} dataset")
    parser.add_argument("--output", required=True, help="Parquet directory to write")
    parser.add_argument("--lookback_days", type=int, default=DEFAULT_LOOKBACK_DAYS)
    parser.add_argument("--max_seq", type=int, default=DEFAULT_MAX_SEQ)
    parser.add_argument("--metrics_json", help="JSON directory to write metrics to")
    parser.add_argument("--source_format", choices=["csv", "parquet"], default="csv")
    parser.add_argument("--partition_by", nargs="*", default=[], help="columns to partition the output by")
    parser.add_argument("--replace", choices=["all", "partitions"], default="all", help="what of the output a run replaces")
    parser.add_argument("--rejects", help="Parquet directory to write lines to that do not parse")
    return parser.parse_args(argv)


def main(argv: Sequence[str] | None = None) -> None:
    args = job_arguments(argv)
    spark = SparkSession.builder.appName("hindsight").getOrCreate()
    run_job(
        spark,
        SourcePaths(args.impressions, args.clicks, args.add_to_carts, args.previous_orders),
        args.output,
        args.lookback_days,
        args.max_seq,
        args.metrics_json,
        args.source_format,
        args.partition_by,
        args.replace,
        args.rejects,
    )
    spark.stop()
