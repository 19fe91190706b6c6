"""

Queries read the given tables through the mappings in ``workloads.mappings``. Arrays are compared
as comma-joined strings, time-zoned timestamps as zone-less ones in UTC.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import hindsight
from workloads import oracles
from workloads.mappings import (
    EVENTS_WINDOW,
    ORDERS_WINDOW,
    dirty_sources,
    event_sources,
    few_customers,
    hot_sources,
    order_sources,
    ranking_wire,
    scratch_path,
    write_csv,
)


# The corpus operators and their pipeline may be absent; everything else works without them.
CORPUS = all(find_spec(name) for name in ("hindsight.llm", "corpus_pipeline"))
if CORPUS:
    import corpus_pipeline
    from hindsight.llm import queries as corpus


def _joined(df: DataFrame) -> DataFrame:
    """Array columns as strings."""
    return df.withColumns(
        {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("actions", "action_types")}
    )


def _event_inputs(spark: SparkSession, sf_dir: str, **window) -> DataFrame:
    return hindsight.build_training_inputs(*event_sources(spark, sf_dir), **(window or EVENTS_WINDOW))


def csv_scan_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = event_sources(spark, sf_dir).clicks
    path = write_csv(clicks, scratch_path(spark, "clicks"))
    scanned = hindsight.read_csv_with_schema(spark, path, hindsight.schema.clicks_schema)
    return scanned.withColumn("click_time", F.col("click_time").cast("timestamp_ntz"))


def csv_bad_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = event_sources(spark, sf_dir).clicks
    odd = clicks.withColumn("item_id", F.when(F.col("item_id") % 7 == 0, "n/a").otherwise(F.col("item_id").cast("string")))
    path = write_csv(odd, scratch_path(spark, "odd-clicks"))
    return hindsight.count_bad_rows(spark, path, hindsight.schema.clicks_schema)


def json_impressions_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = hindsight.coerce_impressions_from_json(ranking_wire(spark, sf_dir))
    slots = F.col("impressions")
    return parsed.select(
        "ranking_id",
        F.when(slots.isNotNull(), F.size(slots)).alias("n_items"),
        F.array_join(slots["item_id"].cast("array<string>"), ",").alias("items"),
        F.array_join(slots["is_order"].cast("array<string>"), ",").alias("flags"),
    )


def explode_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hindsight.explode_impressions(
        hindsight.coerce_impressions_from_json(ranking_wire(spark, sf_dir))
    )


def normalize_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hindsight.normalize_actions(*event_sources(spark, sf_dir)[1:])


def history_asof_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hindsight.impression_activity(
        *event_sources(spark, sf_dir), lookback_days=EVENTS_WINDOW["lookback_days"]
    )


def history_asof_join_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hindsight.impression_activity(
        *order_sources(spark, sf_dir), lookback_days=ORDERS_WINDOW["lookback_days"]
    )


def history_topk_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hindsight.history_entries(*event_sources(spark, sf_dir), **EVENTS_WINDOW)


def training_inputs_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(_event_inputs(spark, sf_dir))


def training_inputs_oldest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(_event_inputs(spark, sf_dir, **EVENTS_WINDOW, order="oldest_first"))


def training_inputs_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(_event_inputs(spark, sf_dir, lookback_days=30, max_seq=3))


def training_inputs_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(hindsight.build_training_inputs(*event_sources(spark, sf_dir)))


def training_inputs_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rankings = hindsight.coerce_impressions_from_json(ranking_wire(spark, sf_dir))
    logs = event_sources(spark, sf_dir)[1:]
    return _joined(hindsight.build_training_inputs(rankings, *logs, **EVENTS_WINDOW))


def training_inputs_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(hindsight.build_training_inputs(*order_sources(spark, sf_dir), **ORDERS_WINDOW))


def training_inputs_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(hindsight.build_training_inputs(*dirty_sources(spark, sf_dir), **EVENTS_WINDOW))


def training_inputs_hot_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(hindsight.build_training_inputs(*hot_sources(spark, sf_dir), **EVENTS_WINDOW))


def history_asof_join_hot_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hindsight.impression_activity(*hot_sources(spark, sf_dir), lookback_days=EVENTS_WINDOW["lookback_days"])


def prune_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What impressions of six days in the middle of the month can look back to over three days."""
    impressions, *logs = event_sources(spark, sf_dir)
    some = impressions.where(F.dayofmonth(F.to_date("dt")).between(12, 17))
    return hindsight.normalize_actions(*hindsight.prune_logs(some, *logs, lookback_days=3))


def dq_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hindsight.dq_summary(_event_inputs(spark, sf_dir))


def dq_summary_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hindsight.dq_summary(hindsight.build_training_inputs(*dirty_sources(spark, sf_dir), **EVENTS_WINDOW))


def dq_action_type_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hindsight.action_type_distribution(_event_inputs(spark, sf_dir))


def sequence_length_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hindsight.sequence_lengths(_event_inputs(spark, sf_dir))


def action_type_freq_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hindsight.action_types_by_position(_event_inputs(spark, sf_dir))


def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    inputs = _event_inputs(spark, sf_dir)
    path = scratch_path(spark, "training-inputs")
    hindsight.save_training_inputs(inputs, path, partition_by=["dt"])
    return _joined(spark.read.schema(inputs.schema).parquet(path))


def metrics_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    metrics = hindsight.dq_metrics(_event_inputs(spark, sf_dir))
    path = scratch_path(spark, "metrics")
    hindsight.save_metrics(metrics, path)
    shares = F.col("action_type_distribution")
    return spark.read.schema(metrics.schema).json(path).select(
        "total_rows",
        "bad_dt_rows",
        "zero_history_pct",
        "avg_history_length",
        *[shares[str(code)].alias(f"share_{code}") for code in range(4)],
    )


def csv_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = event_sources(spark, sf_dir)._replace(impressions=ranking_wire(spark, sf_dir))
    base = scratch_path(spark, "job")
    paths = hindsight.SourcePaths(
        *[write_csv(df, f"{base}/{name}") for name, df in sources._asdict().items()]
    )
    written = hindsight.run_job(
        spark, paths, f"{base}/output", **EVENTS_WINDOW, metrics_path=f"{base}/metrics"
    )
    return _joined(written)


def training_inputs_few_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions of every fiftieth customer only, with the logs of all."""
    return _joined(hindsight.build_training_inputs(*few_customers(spark, sf_dir), **EVENTS_WINDOW))


def history_asof_join_few_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hindsight.impression_activity(*few_customers(spark, sf_dir), lookback_days=EVENTS_WINDOW["lookback_days"])


def training_inputs_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From stored days: half a month at once, then the other half, then a day that is stored already."""
    impressions, *logs = event_sources(spark, sf_dir)
    path = scratch_path(spark, "action-days")
    for first, last in ((1, 15), (16, 31), (9, 9)):
        hindsight.save_action_days(*logs, path, date(2024, 1, first), date(2024, 1, last), max_seq=EVENTS_WINDOW["max_seq"])
    stored = hindsight.load_action_days(spark, path, max_seq=EVENTS_WINDOW["max_seq"])
    return _joined(hindsight.build_training_inputs_from_days(impressions, stored, **EVENTS_WINDOW))


def parquet_rerun_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All days written, one of them without its logs; then that day is run again."""
    inputs = _event_inputs(spark, sf_dir)
    sources = event_sources(spark, sf_dir)
    day = F.col("dt") == "2024-01-20"
    without_logs = hindsight.build_training_inputs(
        sources.impressions.where(day), *[log.where(F.lit(False)) for log in sources[1:]], **EVENTS_WINDOW
    )
    path = scratch_path(spark, "rerun")
    hindsight.save_training_inputs(inputs.where(~day).unionByName(without_logs), path, partition_by=["dt"])
    rerun = hindsight.build_training_inputs(sources.impressions.where(day), *sources[1:], **EVENTS_WINDOW)
    hindsight.save_training_inputs(rerun, path, partition_by=["dt"], replace="partitions")
    return _joined(spark.read.schema(inputs.schema).parquet(path))


def job_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the job observes while it writes, rankings that are not JSON included."""
    sources = event_sources(spark, sf_dir)._replace(impressions=ranking_wire(spark, sf_dir))
    base = scratch_path(spark, "job-metrics")
    paths = hindsight.SourcePaths(*[write_csv(df, f"{base}/{name}") for name, df in sources._asdict().items()])
    kept = {"metrics_path": f"{base}/metrics", "rejects_path": f"{base}/rejects"}
    hindsight.run_job(spark, paths, f"{base}/output", **EVENTS_WINDOW, **kept)
    columns = "total_rows long, bad_dt_rows long, bad_impressions_rows long, zero_history_pct double, avg_history_length double"
    shares = F.col("action_type_distribution")
    metrics = spark.read.schema(f"{columns}, action_type_distribution map<string, double>").json(f"{base}/metrics")
    return metrics.select(*metrics.columns[:5], *[shares[str(code)].alias(f"share_{code}") for code in range(4)])


def dq_summary_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rankings = hindsight.coerce_impressions_from_json(ranking_wire(spark, sf_dir), flag="bad_impressions")
    return hindsight.dq_summary(hindsight.build_training_inputs(rankings, *event_sources(spark, sf_dir)[1:], **EVENTS_WINDOW))


def json_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hindsight.bad_impressions(ranking_wire(spark, sf_dir))


def csv_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with an item that is no number, as they stand in the files."""
    clicks = event_sources(spark, sf_dir).clicks
    odd = clicks.withColumn("item_id", F.when(F.col("item_id") % 7 == 0, "n/a").otherwise(F.col("item_id").cast("string")))
    path = write_csv(odd, scratch_path(spark, "rejected-clicks"))
    rejects = hindsight.csv_rejects(spark, path, hindsight.schema.clicks_schema)
    known = F.col("file").contains(path.rstrip("/").split("/")[-1]) & (F.col("block_start") >= 0)
    return rejects.select("line", F.array_join("null_cells", ",").alias("null_cells"), known.alias("known_place"))


def _daily_metrics(spark: SparkSession, inputs: DataFrame, least: str = "2024-01-16") -> DataFrame:
    """Metrics by day, stored in two runs."""
    path = scratch_path(spark, "metrics-by-day")
    late = F.coalesce(F.col("dt") >= least, F.lit(False))
    for part in (inputs.where(~late), inputs.where(late)):
        hindsight.replace_partitions(hindsight.metrics_by_day(part), path, ["dt"])
    return spark.read.schema(hindsight.metrics_by_day(inputs).schema).parquet(path)


def merged_sequence_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hindsight.merged_sequence_lengths(_daily_metrics(spark, _event_inputs(spark, sf_dir)))


def merged_action_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hindsight.merged_action_types(_daily_metrics(spark, _event_inputs(spark, sf_dir)))


def merged_types_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hindsight.merged_types_by_position(_daily_metrics(spark, _event_inputs(spark, sf_dir)))


def merged_summary_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = hindsight.build_training_inputs(*dirty_sources(spark, sf_dir), **EVENTS_WINDOW)
    return hindsight.merged_summary(_daily_metrics(spark, dirty))


#: The queries of the library itself, each with its SQL.
LIBRARY = (
    csv_scan_typed,
    csv_bad_rows,
    json_impressions_parse,
    explode_impressions,
    normalize_actions,
    prune_logs,
    history_asof_join,
    history_asof_join_orders,
    history_asof_join_hot_customer,
    history_topk_long,
    training_inputs_events,
    training_inputs_oldest_first,
    training_inputs_short,
    training_inputs_defaults,
    training_inputs_rankings,
    training_inputs_orders,
    training_inputs_dirty,
    training_inputs_hot_customer,
    dq_summary,
    dq_summary_dirty,
    dq_action_type_distribution,
    sequence_length_distribution,
    action_type_freq_by_position,
    parquet_roundtrip,
    metrics_json_roundtrip,
    csv_job,
    training_inputs_few_customers,
    history_asof_join_few_customers,
    training_inputs_incremental,
    parquet_rerun_day,
    job_metrics,
    dq_summary_rejects,
    json_rejects,
    csv_rejects,
    merged_sequence_lengths,
    merged_action_types,
    merged_types_by_position,
    merged_summary_dirty,
)


def entry(spark: SparkSession) -> DataFrame:
    return _event_inputs(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {query.__name__: query for query in LIBRARY}
    return {**own, **corpus.queries(), "pipeline": corpus_pipeline.run} if CORPUS else own


def oracle_sql() -> dict[str, str]:
    sql = oracles.sql()
    if CORPUS:
        sql |= corpus.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
