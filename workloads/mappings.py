"""The four datasets of the contract, derived from the given test tables.

``events`` (January 2024): views are rankings of one item, clicks are clicks, sign-ups stand in for
add-to-carts, purchases are orders. The item is ``props.k`` plus one, because 0 means padding.

``orders`` / ``lineitem`` (1995 to 2001): each order line is a ranking of one item and an order
action, so every time is a midnight and ties are the rule.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hindsight.sources.datasets import Sources

EVENTS_WINDOW = {"lookback_days": 7, "max_seq": 10}
ORDERS_WINDOW = {"lookback_days": 365, "max_seq": 20}

# Strings that a lenient cast would take for a day.
NO_DAYS = ("2024", "2024-01", "2024-1-20", " 2024-01-20 ", "2024-01-20 13:00:00", "2024-01-20T13:00", "2024-02-30", None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _event_item() -> Column:
    return F.get_json_object("props", "$.k").cast("int") + 1


def _event_day() -> Column:
    return F.date_format("ts", "yyyy-MM-dd")


def _slot(item: Column, is_order: Column) -> Column:
    return F.struct(item.alias("item_id"), is_order.alias("is_order"))


def _event_logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events")
    customer = F.col("user_id").alias("customer_id")
    simple = F.lit(1).alias("simple_id")
    clicks = events.where("event_type = 'click'").select(
        _event_day().alias("dt"), customer, _event_item().alias("item_id"), F.col("ts").alias("click_time")
    )
    carts = events.where("event_type = 'signup'").select(
        _event_day().alias("dt"),
        customer,
        _event_item().alias("config_id"),
        simple,
        F.col("ts").alias("occurred_at"),
    )
    orders = events.where("event_type = 'purchase'").select(
        F.to_date("ts").alias("order_date"), customer, _event_item().alias("config_id"), simple
    )
    return clicks, carts, orders


def event_sources(spark: SparkSession, sf_dir: str) -> Sources:
    views = table(spark, sf_dir, "events").where("event_type = 'view'")
    impressions = views.select(
        _event_day().alias("dt"),
        F.col("event_id").cast("string").alias("ranking_id"),
        F.col("user_id").alias("customer_id"),
        F.array(_slot(_event_item(), F.col("value") > 20)).alias("impressions"),
    )
    return Sources(impressions, *_event_logs(spark, sf_dir))


def dirty_sources(spark: SparkSession, sf_dir: str) -> Sources:
    """The events with what logs should not have: errors show as rankings whose day is no day, every
    eleventh item belongs to nobody, and clicks on every seventh have no time."""
    sources = event_sources(spark, sf_dir)
    k = _event_item()
    no_day = F.element_at(F.array(*[F.lit(d) for d in NO_DAYS]), k % len(NO_DAYS) + 1)
    errors = (
        table(spark, sf_dir, "events")
        .where("event_type = 'error'")
        .select(
            no_day.alias("dt"),
            F.col("event_id").cast("string").alias("ranking_id"),
            F.col("user_id").alias("customer_id"),
            F.array(_slot(k, F.lit(False))).alias("impressions"),
        )
    )

    def known(item: Column) -> Column:
        return F.when(item % 11 != 0, F.col("customer_id"))

    clicks = sources.clicks.withColumn("customer_id", known(F.col("item_id")))
    return Sources(
        sources.impressions.withColumn("customer_id", known(F.col("impressions")[0]["item_id"])).unionByName(errors),
        clicks.withColumn("click_time", F.when(F.col("item_id") % 7 != 0, F.col("click_time"))),
        sources.add_to_carts.withColumn("customer_id", known(F.col("config_id"))),
        sources.previous_orders.withColumn("customer_id", known(F.col("config_id"))),
    )


def hot_sources(spark: SparkSession, sf_dir: str) -> Sources:
    """The events with a third of all customers being one."""
    one = F.when(F.col("customer_id") % 3 != 0, F.col("customer_id")).otherwise(0)
    return Sources(*[df.withColumn("customer_id", one) for df in event_sources(spark, sf_dir)])


def few_customers(spark: SparkSession, sf_dir: str) -> Sources:
    """The events with the impressions of every fiftieth customer only; the logs are whole."""
    sources = event_sources(spark, sf_dir)
    return sources._replace(impressions=sources.impressions.where(F.col("customer_id") % 50 == 0))


def ranking_wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rankings as they arrive, with the items as JSON text.

    Views show up to three items, the third repeating the first with another flag; errors carry
    no text, text that is not JSON, or an empty array.
    """
    k = F.get_json_object("props", "$.k").cast("int")

    def slot(item: Column, is_order: Column) -> Column:
        return F.concat(
            F.lit('{"item_id":'), item.cast("string"), F.lit(',"is_order":'), is_order.cast("string"), F.lit("}")
        )

    slots = F.array(slot(k + 1, F.col("value") > 20), slot(k * 7 % 100 + 1, F.lit(False)), slot(k + 1, F.lit(True)))
    shown = F.concat(F.lit("["), F.array_join(F.slice(slots, F.lit(1), k % 4), ","), F.lit("]"))
    broken = F.when(k % 3 == 1, "not json").when(k % 3 == 2, "[]")
    return (
        table(spark, sf_dir, "events")
        .where("event_type IN ('view', 'error')")
        .select(
            _event_day().alias("dt"),
            F.col("event_id").cast("string").alias("ranking_id"),
            F.col("user_id").alias("customer_id"),
            F.when(F.col("event_type") == "view", shown).otherwise(broken).alias("impressions"),
        )
    )


def order_sources(spark: SparkSession, sf_dir: str) -> Sources:
    lines = table(spark, sf_dir, "lineitem").join(
        table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")
    )
    customer = F.col("o_custkey").alias("customer_id")
    item = (F.col("l_partkey") + 1).cast("int")
    day = F.date_format("o_orderdate", "yyyy-MM-dd").alias("dt")
    impressions = lines.select(
        day,
        F.col("o_orderkey").cast("string").alias("ranking_id"),
        customer,
        F.array(_slot(item, F.col("l_returnflag") != "R")).alias("impressions"),
    )
    orders = lines.select(
        F.to_date("o_orderdate").alias("order_date"),
        customer,
        item.alias("config_id"),
        F.col("l_linenumber").alias("simple_id"),
    )
    # This mapping has no clicks and no add-to-carts.
    nothing = lines.where(F.lit(False))
    clicks = nothing.select(day, customer, item.alias("item_id"), F.col("l_shipdate").alias("click_time"))
    carts = nothing.select(
        day,
        customer,
        item.alias("config_id"),
        F.col("l_linenumber").alias("simple_id"),
        F.col("l_shipdate").alias("occurred_at"),
    )
    return Sources(impressions, clicks, carts, orders)


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with a header, doubled quotes and times to the microsecond."""
    times = "yyyy-MM-dd HH:mm:ss.SSSSSS"
    (
        df.write.option("header", True)
        .option("escape", '"')
        .option("timestampFormat", times)
        .option("timestampNTZFormat", times)
        .csv(path)
    )
    return path
