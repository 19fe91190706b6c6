"""Benchmark: headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``, one JSON line.

Each query is written to Spark's ``noop`` sink, which produces every row and column. The queries
take turns; the first of ``$BENCH_RUNS`` rounds warms up and is left out, the best of the others
counts. ``value`` is the sum over the engine's queries. The per-impression shape (join, rank all
pairs, collect), as plain SQL, takes the same turns for comparison and is not part of the sum.
"""

import json
import os
import time

from pyspark.sql import SparkSession

import hindsight
from workloads import oracles
from workloads.mappings import EVENTS_WINDOW, ORDERS_WINDOW, event_sources, hot_sources, order_sources, table

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "4"))


def headline(spark):
    events, orders = event_sources(spark, SF_DIR), order_sources(spark, SF_DIR)
    inputs = hindsight.build_training_inputs(*events, **EVENTS_WINDOW)
    return {
        "training_inputs_events": inputs,
        "training_inputs_hot_customer": hindsight.build_training_inputs(*hot_sources(spark, SF_DIR), **EVENTS_WINDOW),
        "training_inputs_events_default_window": hindsight.build_training_inputs(*events),
        "training_inputs_orders": hindsight.build_training_inputs(*orders, **ORDERS_WINDOW),
        "history_asof_join": hindsight.impression_activity(*events, lookback_days=7),
        "history_topk_long": hindsight.history_entries(*events, **EVENTS_WINDOW),
        "normalize_actions": hindsight.normalize_actions(*events[1:]),
        "explode_impressions": hindsight.explode_impressions(events.impressions),
        "dq_metrics": hindsight.dq_metrics(inputs),
        "sequence_length_distribution": hindsight.sequence_lengths(inputs),
        "action_type_freq_by_position": hindsight.action_types_by_position(inputs),
    }


def comparison(spark):
    """The SQL counterparts, written per impression, run by the same engine."""
    for name in ("events", "orders", "lineitem"):
        table(spark, SF_DIR, name).createOrReplaceTempView(name)
    return {name: spark.sql(text) for name, text in oracles.for_spark().items()}


def run(df) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def best_of_rounds(frames):
    rounds = [{name: run(df) for name, df in frames.items()} for _ in range(RUNS)]
    return {name: round(min(r[name] for r in rounds[1:] or rounds), 3) for name in frames}


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        # Tables of a few MB: let adaptive execution keep all cores busy with small partitions.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        # All queries take turns, so their generated code has to fit into the cache together.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    frames = headline(spark)
    shapes = {f"per_impression/{name}": df for name, df in comparison(spark).items()}
    times = best_of_rounds({**frames, **shapes})
    queries = {name: times[name] for name in frames}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(queries.values()), 3),
                "unit": "sec",
                "queries": queries,
                "per_impression_shape": {name.split("/")[1]: times[name] for name in shapes},
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
