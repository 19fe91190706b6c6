"""Small inputs written out by hand, and a brute-force answer to compare with."""

import random
import re
from datetime import date, datetime, timedelta

import hindsight
from hindsight import schema


def sources(spark, impressions, clicks=(), carts=(), orders=()):
    return (
        spark.createDataFrame(list(impressions), schema.impressions_schema),
        spark.createDataFrame(list(clicks), schema.clicks_schema),
        spark.createDataFrame(list(carts), schema.add_to_carts_schema),
        spark.createDataFrame(list(orders), schema.previous_orders_schema),
    )


def click(customer, item, when):
    return (when[:10] if when else None, customer, item, datetime.fromisoformat(when) if when else None)


def cart(customer, item, when):
    return (when[:10], customer, item, 1, datetime.fromisoformat(when))


def order(customer, item, day):
    return (date.fromisoformat(day), customer, item, 1)


def ranking(dt, ranking_id, customer, *items):
    return (dt, ranking_id, customer, [{"item_id": i, "is_order": o} for i, o in items])


SMALL_DAY = "2023-03-15"


def small(spark):
    """Two rankings. With the default look-back one order lies on the edge of its window (in), the
    other a day before it (out)."""
    return sources(
        spark,
        [
            ranking(SMALL_DAY, "morning", 11, (7, False), (8, True)),
            ranking(SMALL_DAY, "evening", 12, (9, False)),
        ],
        [click(11, 7, "2023-03-14 08:15:30"), click(12, 9, "2023-03-14 21:40:00")],
        [cart(11, 8, "2023-03-10 17:05:00")],
        [order(11, 5, "2022-03-14"), order(12, 6, "2022-03-15")],
    )


def _line(*cells):
    return ",".join(map(str, cells)) + "\n"


SMALL_CSV = {
    "impressions": _line("dt", "ranking_id", "customer_id", "impressions")
    + _line(SMALL_DAY, "morning", 11, '"[{""item_id"":7,""is_order"":false},{""item_id"":8,""is_order"":true}]"')
    + _line(SMALL_DAY, "evening", 12, '"[{""item_id"":9,""is_order"":false}]"'),
    "clicks": _line("dt", "customer_id", "item_id", "click_time")
    + _line("2023-03-14", 11, 7, "2023-03-14 08:15:30")
    + _line("2023-03-14", 12, 9, "2023-03-14 21:40:00"),
    "add_to_carts": _line("dt", "customer_id", "config_id", "simple_id", "occurred_at")
    + _line("2023-03-10", 11, 8, 1, "2023-03-10 17:05:00"),
    "previous_orders": _line("order_date", "customer_id", "config_id", "simple_id")
    + _line("2022-03-14", 11, 5, 1)
    + _line("2022-03-15", 12, 6, 1),
}

SMALL_EXPECTED = [
    (SMALL_DAY, "morning", 11, 7, False, [7, 8, 0, 0], [1, 2, 0, 0]),
    (SMALL_DAY, "morning", 11, 8, True, [7, 8, 0, 0], [1, 2, 0, 0]),
    (SMALL_DAY, "evening", 12, 9, False, [9, 6, 0, 0], [1, 3, 0, 0]),
]


def medium(spark):
    """Some 200 customers with overlapping logs over a year and a half, drawn from a seeded generator."""
    rng = random.Random(17)
    start = datetime(2022, 1, 10)

    def moment(days):
        return (start + timedelta(days=rng.randrange(days), seconds=rng.randrange(86400))).isoformat(" ")

    clicks = [click(rng.randrange(500, 700), rng.randrange(1, 90), moment(420)) for _ in range(450)]
    carts = [cart(rng.randrange(500, 700), rng.randrange(1, 90), moment(420)) for _ in range(380)]
    orders = [order(rng.randrange(500, 700), rng.randrange(1, 90), moment(560)[:10]) for _ in range(260)]
    rankings = [ranking("2023-02-20", f"m{c}", c, (c % 90, False), (c % 7, True)) for c in range(500, 700)]
    return sources(spark, rankings, clicks, carts, orders)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_force(impressions, clicks, carts, orders, lookback_days, max_seq, oldest_first=False):
    """The contract in plain Python, on collected inputs."""
    actions = [(r.customer_id, r.click_time, 1, r.item_id) for r in clicks.collect()]
    actions += [(r.customer_id, r.occurred_at, 2, r.config_id) for r in carts.collect()]
    actions += [
        (r.customer_id, r.order_date and datetime.combine(r.order_date, datetime.min.time()), 3, r.config_id)
        for r in orders.collect()
    ]
    result = []
    for r in impressions.collect():
        try:
            end = datetime.fromisoformat(r.dt) if re.fullmatch("[0-9]{4}-[0-9]{2}-[0-9]{2}", r.dt or "") else None
        except ValueError:
            end = None
        history = []
        if end is not None and r.customer_id is not None:
            start = end - timedelta(days=lookback_days)
            history = [a for a in actions if a[0] == r.customer_id and a[1] and start <= a[1] < end]
            history.sort(key=lambda a: (a[1], a[2], -1 if a[3] is None else a[3]), reverse=True)
            history = history[:max_seq]
        if oldest_first:
            history.reverse()
        padding = [0] * (max_seq - len(history))
        items = [a[3] for a in history] + padding
        types = [a[2] for a in history] + padding
        for slot in r.impressions or [None]:
            item, flag = (slot.item_id, slot.is_order) if slot else (None, None)
            result.append((r.dt, r.ranking_id, r.customer_id, item, flag, items, types))
    return sorted(result, key=repr)


def write_small_csv(directory):
    for name, text in SMALL_CSV.items():
        (directory / f"{name}.csv").write_text(text)
    return hindsight.SourcePaths(*[str(directory / f"{n}.csv") for n in hindsight.SourcePaths._fields])
