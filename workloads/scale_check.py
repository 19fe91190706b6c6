"""Time the engine on larger, optionally skewed data blown up from the ``events`` table.

    python -m workloads.scale_check --sf_dir /root/testdata/sf0.1 --copies 200 [--hot 3]

Each copy of an event belongs to another customer, or, for one copy in ``--hot``, to customer 0. The
datasets are written as Parquet to the session's shared folder first, then timed with the ``noop`` sink.
"""

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import hindsight
from workloads.mappings import event_sources, scratch_path


def blown_up(df: DataFrame, copies: int, hot: int | None) -> DataFrame:
    """``copies`` of each row, with customers of their own."""
    copy = F.col("copy")
    customer = (F.col("customer_id") * copies + copy + 1).cast("int")
    if hot:
        customer = F.when(copy % hot == 0, 0).otherwise(customer)
    many = df.repartition(32).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return many.withColumn("customer_id", customer).drop("copy")


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--sf_dir", required=True)
    parser.add_argument("--copies", type=int, default=100)
    parser.add_argument("--hot", type=int, help="one copy in this many belongs to a single customer")
    parser.add_argument("--lookback_days", type=int, default=7)
    parser.add_argument("--max_seq", type=int, default=50)
    args = parser.parse_args()

    spark = SparkSession.builder.appName("scale-check").getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    base = scratch_path(spark, "scale")
    for name, df in event_sources(spark, args.sf_dir)._asdict().items():
        blown_up(df, args.copies, args.hot).write.parquet(f"{base}/{name}")
    paths = hindsight.SourcePaths(*[f"{base}/{name}" for name in hindsight.SourcePaths._fields])
    sources = hindsight.load_sources(spark, paths, "parquet")
    window = {"lookback_days": args.lookback_days, "max_seq": args.max_seq}
    plans = {"build_training_inputs": hindsight.build_training_inputs(*sources, **window)}
    for _ in range(2):
        for name, df in plans.items():
            start = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            print(f"{name}: {time.perf_counter() - start:.1f} s", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
