"""DuckDB SQL for each registered query, written per impression and independent of the engine."""

_EVENTS = """
ev AS (SELECT *, CAST(props::json->>'k' AS INTEGER) AS k FROM events),
act AS (SELECT user_id AS customer_id, k + 1 AS item_id,
               CASE WHEN event_type = 'purchase' THEN date_trunc('day', ts) ELSE ts END AS ts,
               CASE event_type WHEN 'click' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS action_type
        FROM ev WHERE event_type IN ('click', 'signup', 'purchase'))"""

_EVENT_IMPRESSIONS = """
imp AS (SELECT event_id AS rid, strftime(ts, '%Y-%m-%d') AS dt, CAST(event_id AS VARCHAR) AS ranking_id,
               user_id AS customer_id, k + 1 AS impression_item_id, value > 20 AS is_order
        FROM ev WHERE event_type = 'view')"""

_WIRE = """
wire AS (SELECT strftime(ts, '%Y-%m-%d') AS dt, CAST(event_id AS VARCHAR) AS ranking_id,
                user_id AS customer_id, k, value, event_type,
                CASE WHEN event_type = 'view' THEN k % 4 WHEN k % 3 = 2 THEN 0 END AS n_items
         FROM ev WHERE event_type IN ('view', 'error')),
slots AS (SELECT ranking_id, pos,
                 CASE pos WHEN 2 THEN k * 7 % 100 + 1 ELSE k + 1 END AS item_id,
                 CASE pos WHEN 1 THEN value > 20 WHEN 2 THEN FALSE ELSE TRUE END AS is_order
          FROM wire JOIN (VALUES (1), (2), (3)) p(pos) ON pos <= n_items)"""

_WIRE_IMPRESSIONS = f"""{_WIRE},
imp AS (SELECT row_number() OVER () AS rid, dt, w.ranking_id, customer_id,
               item_id AS impression_item_id, is_order
        FROM wire w LEFT JOIN slots s ON w.ranking_id = s.ranking_id)"""

_ORDERS = """
lines AS (SELECT row_number() OVER () AS rid, o_orderdate, o_orderkey, o_custkey, l_partkey + 1 AS item,
                 l_returnflag
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
act AS (SELECT o_custkey AS customer_id, item AS item_id, date_trunc('day', o_orderdate) AS ts,
               3 AS action_type FROM lines),
imp AS (SELECT rid, strftime(o_orderdate, '%Y-%m-%d') AS dt, CAST(o_orderkey AS VARCHAR) AS ranking_id,
               o_custkey AS customer_id, item AS impression_item_id, l_returnflag <> 'R' AS is_order
        FROM lines)"""


_DIRTY = """
ev AS (SELECT *, CAST(props::json->>'k' AS INTEGER) AS k FROM events),
act AS (SELECT CASE WHEN (k + 1) % 11 <> 0 THEN user_id END AS customer_id, k + 1 AS item_id,
               CASE WHEN event_type = 'purchase' THEN date_trunc('day', ts)
                    WHEN event_type = 'signup' OR (k + 1) % 7 <> 0 THEN ts END AS ts,
               CASE event_type WHEN 'click' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS action_type
        FROM ev WHERE event_type IN ('click', 'signup', 'purchase')),
imp AS (SELECT event_id AS rid,
               CASE WHEN event_type = 'view' THEN strftime(ts, '%Y-%m-%d')
                    ELSE (['2024', '2024-01', '2024-1-20', ' 2024-01-20 ', '2024-01-20 13:00:00', '2024-01-20T13:00',
                           '2024-02-30', NULL])[(k + 1) % 8 + 1] END AS dt,
               CAST(event_id AS VARCHAR) AS ranking_id,
               CASE WHEN event_type = 'error' OR (k + 1) % 11 <> 0 THEN user_id END AS customer_id,
               k + 1 AS impression_item_id, event_type = 'view' AND value > 20 AS is_order
        FROM ev WHERE event_type IN ('view', 'error'))"""

_HOT = f"""{_EVENTS.replace("act AS", "act0 AS")}, {_EVENT_IMPRESSIONS.replace("imp AS", "imp0 AS")},
act AS (SELECT * REPLACE (CASE WHEN customer_id % 3 <> 0 THEN customer_id ELSE 0 END AS customer_id) FROM act0),
imp AS (SELECT * REPLACE (CASE WHEN customer_id % 3 <> 0 THEN customer_id ELSE 0 END AS customer_id) FROM imp0)"""

_FEW = f"""{_EVENTS}, {_EVENT_IMPRESSIONS.replace("imp AS", "imp0 AS")},
imp AS (SELECT * FROM imp0 WHERE customer_id % 50 = 0)"""

_IS_DAY = "regexp_full_match(dt, '[0-9]{4}-[0-9]{2}-[0-9]{2}') AND try_cast(dt AS DATE) IS NOT NULL"

_SUMMARY = f"""
SELECT count(*) AS total_rows, count(*) - count(CASE WHEN {_IS_DAY} THEN 1 END) AS bad_dt_rows,
       avg(CASE WHEN history_length = 0 THEN 1.0 ELSE 0.0 END) AS zero_history_pct,
       avg(history_length) AS avg_history_length FROM train"""


def _in_window(days: int) -> str:
    day = f"CASE WHEN {_IS_DAY.replace('dt', 'i.dt')} THEN CAST(try_cast(i.dt AS DATE) AS TIMESTAMP) END"
    return f"""a.customer_id = i.customer_id AND a.ts < {day} AND a.ts >= {day} - INTERVAL {days} DAY"""


def _ranked(days: int, k: int) -> str:
    return f"""
r AS (SELECT * FROM (
        SELECT i.*, a.item_id, a.action_type, row_number() OVER (PARTITION BY i.rid
               ORDER BY a.ts DESC, a.action_type DESC, a.item_id DESC) AS rn
        FROM imp i JOIN act a ON {_in_window(days)}) WHERE rn <= {k})"""


def _sequences(k: int, direction: str = "ASC") -> str:
    return f"""
seq AS (SELECT rid, list(item_id ORDER BY rn {direction}) AS items,
               list(action_type ORDER BY rn {direction}) AS types FROM r GROUP BY rid),
train AS (SELECT i.*, coalesce(len(items), 0) AS history_length,
                 list_resize(coalesce(items, []), {k}, 0) AS actions,
                 list_resize(coalesce(types, []), {k}, 0) AS action_types
          FROM imp i LEFT JOIN seq ON i.rid = seq.rid)"""


_TRAIN = """
SELECT dt, ranking_id, customer_id, impression_item_id, is_order,
       array_to_string(actions, ',') AS actions, array_to_string(action_types, ',') AS action_types
FROM train"""


def _training(base: str, days: int, k: int, direction: str = "ASC") -> str:
    return f"WITH {base}, {_ranked(days, k)}, {_sequences(k, direction)}"


def _activity(base: str, days: int) -> str:
    return f"""WITH {base}
SELECT i.dt, i.ranking_id, i.customer_id, i.impression_item_id, i.is_order,
       count(a.ts) AS n_actions,
       count(CASE WHEN a.action_type = 1 THEN 1 END) AS n_clicks,
       count(CASE WHEN a.action_type = 2 THEN 1 END) AS n_add_to_carts,
       count(CASE WHEN a.action_type = 3 THEN 1 END) AS n_orders,
       min(a.ts) AS first_ts, max(a.ts) AS last_ts
FROM imp i LEFT JOIN act a ON {_in_window(days)}
GROUP BY i.rid, i.dt, i.ranking_id, i.customer_id, i.impression_item_id, i.is_order"""


def sql() -> dict[str, str]:
    events = f"{_EVENTS}, {_EVENT_IMPRESSIONS}"
    rankings = f"{_EVENTS}, {_WIRE_IMPRESSIONS}"
    train = _training(events, 7, 10)
    shares = "(SELECT unnest(action_types) AS action_type FROM train)"
    shares_of = """
       sum(n_0) / (count(*) * 10) AS share_0, sum(n_1) / (count(*) * 10) AS share_1,
       sum(n_2) / (count(*) * 10) AS share_2, sum(n_3) / (count(*) * 10) AS share_3
FROM (SELECT train.*, 10 - history_length AS n_0,
             len(list_where(types, [t = 1 FOR t IN types])) AS n_1,
             len(list_where(types, [t = 2 FOR t IN types])) AS n_2,
             len(list_where(types, [t = 3 FOR t IN types])) AS n_3
      FROM (SELECT *, action_types AS types FROM train) train)"""
    rejected = "(SELECT count(*) FROM wire WHERE event_type = 'error' AND k % 3 = 1)"
    summary = f"""count(*) AS total_rows, count(*) - count(CASE WHEN {_IS_DAY} THEN 1 END) AS bad_dt_rows,
       {rejected} AS bad_impressions_rows,
       avg(CASE WHEN history_length = 0 THEN 1.0 ELSE 0.0 END) AS zero_history_pct, avg(history_length) AS avg_history_length"""
    return {
        "training_inputs_few_customers": f"{_training(_FEW, 7, 10)} {_TRAIN}",
        "history_asof_join_few_customers": _activity(_FEW, 7),
        "training_inputs_incremental": f"{train} {_TRAIN}",
        "parquet_rerun_day": f"{train} {_TRAIN}",
        "job_metrics": f"{_training(rankings, 7, 10)} SELECT {summary}, {shares_of}",
        "dq_summary_rejects": f"{_training(rankings, 7, 10)} SELECT {summary} FROM train",
        "json_rejects": f"""WITH {_EVENTS}, {_WIRE}
SELECT dt, ranking_id, customer_id, 'not json' AS impressions FROM wire WHERE event_type = 'error' AND k % 3 = 1""",
        "csv_rejects": f"""WITH {_EVENTS}
SELECT strftime(ts, '%Y-%m-%d') || ',' || user_id || ',n/a,' || strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS line,
       'item_id' AS null_cells, TRUE AS known_place FROM ev WHERE event_type = 'click' AND (k + 1) % 7 = 0""",
        "merged_sequence_lengths": f"""{train}
SELECT history_length, count(*) AS n FROM train GROUP BY history_length""",
        "merged_action_types": f"""{train}
SELECT action_type, count(*) AS n, count(*) / (SELECT count(*) * 10 FROM train) AS share
FROM {shares} GROUP BY action_type""",
        "merged_types_by_position": f"""{train}
SELECT pos - 1 AS pos, action_types[pos] AS action_type, count(*) AS n,
       count(*) / (SELECT count(*) FROM train) AS share
FROM train, (SELECT unnest(range(1, 11)) AS pos) p GROUP BY pos, action_types[pos]""",
        "merged_summary_dirty": f"{_training(_DIRTY, 7, 10)} {_SUMMARY}",
        "csv_scan_typed": f"""WITH {_EVENTS}
SELECT strftime(ts, '%Y-%m-%d') AS dt, user_id AS customer_id, k + 1 AS item_id, ts AS click_time
FROM ev WHERE event_type = 'click'""",
        "csv_bad_rows": f"""WITH {_EVENTS}
SELECT count(*) AS total_rows, count(CASE WHEN (k + 1) % 7 = 0 THEN 1 END) AS bad_rows,
       0 AS null_dt, 0 AS null_customer_id, count(CASE WHEN (k + 1) % 7 = 0 THEN 1 END) AS null_item_id,
       0 AS null_click_time
FROM ev WHERE event_type = 'click'""",
        "json_impressions_parse": f"""WITH {_EVENTS}, {_WIRE}
SELECT w.ranking_id, w.n_items,
       CASE WHEN n_items IS NOT NULL THEN coalesce(string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY pos), '') END
         AS items,
       CASE WHEN n_items IS NOT NULL THEN coalesce(string_agg(CAST(is_order AS VARCHAR), ',' ORDER BY pos), '') END
         AS flags
FROM wire w LEFT JOIN slots s ON w.ranking_id = s.ranking_id GROUP BY w.ranking_id, w.n_items""",
        "explode_impressions": f"""WITH {rankings}
SELECT dt, ranking_id, customer_id, impression_item_id, is_order FROM imp""",
        "normalize_actions": f"WITH {_EVENTS} SELECT customer_id, item_id, ts, action_type FROM act",
        "history_asof_join": _activity(events, 7),
        "history_asof_join_orders": _activity(_ORDERS, 365),
        "history_topk_long": f"""WITH {events}, {_ranked(7, 10)}
SELECT dt, ranking_id, customer_id, impression_item_id, rn, item_id, action_type FROM r""",
        "training_inputs_events": f"{train} {_TRAIN}",
        "training_inputs_oldest_first": f"{_training(events, 7, 10, 'DESC')} {_TRAIN}",
        "training_inputs_short": f"{_training(events, 30, 3)} {_TRAIN}",
        "training_inputs_defaults": f"{_training(events, 365, 1000)} {_TRAIN}",
        "training_inputs_rankings": f"{_training(rankings, 7, 10)} {_TRAIN}",
        "training_inputs_orders": f"{_training(_ORDERS, 365, 20)} {_TRAIN}",
        "training_inputs_dirty": f"{_training(_DIRTY, 7, 10)} {_TRAIN}",
        "training_inputs_hot_customer": f"{_training(_HOT, 7, 10)} {_TRAIN}",
        "history_asof_join_hot_customer": _activity(_HOT, 7),
        "prune_logs": f"""WITH {_EVENTS}, imp AS (SELECT min(ts) AS low, max(ts) AS high FROM ev
       WHERE event_type = 'view' AND dayofmonth(ts) BETWEEN 12 AND 17)
SELECT customer_id, item_id, ts, action_type FROM act, imp
WHERE ts >= date_trunc('day', low) - INTERVAL 3 DAY AND ts < date_trunc('day', high)""",
        "dq_summary": f"{train} {_SUMMARY}",
        "dq_summary_dirty": f"{_training(_DIRTY, 7, 10)} {_SUMMARY}",
        "dq_action_type_distribution": f"""{train}
SELECT action_type, count(*) AS n, count(*) / (SELECT count(*) * 10 FROM train) AS share
FROM {shares} GROUP BY action_type""",
        "sequence_length_distribution": f"""{train}
SELECT history_length, count(*) AS n FROM train GROUP BY history_length""",
        "action_type_freq_by_position": f"""{train}
SELECT pos - 1 AS pos, action_types[pos] AS action_type, count(*) AS n,
       count(*) / (SELECT count(*) FROM train) AS share
FROM train, (SELECT unnest(range(1, 11)) AS pos) p GROUP BY pos, action_types[pos]""",
        "parquet_roundtrip": f"{train} {_TRAIN}",
        "metrics_json_roundtrip": f"""{train}
SELECT count(*) AS total_rows, count(*) - count(CASE WHEN {_IS_DAY} THEN 1 END) AS bad_dt_rows,
       avg(CASE WHEN history_length = 0 THEN 1.0 ELSE 0.0 END) AS zero_history_pct,
       avg(history_length) AS avg_history_length,
       sum(n_0) / (count(*) * 10) AS share_0, sum(n_1) / (count(*) * 10) AS share_1,
       sum(n_2) / (count(*) * 10) AS share_2, sum(n_3) / (count(*) * 10) AS share_3
FROM (SELECT train.*, 10 - history_length AS n_0,
             len(list_where(types, [t = 1 FOR t IN types])) AS n_1,
             len(list_where(types, [t = 2 FOR t IN types])) AS n_2,
             len(list_where(types, [t = 3 FOR t IN types])) AS n_3
      FROM (SELECT *, action_types AS types FROM train) train)""",
        "csv_job": f"{_training(rankings, 7, 10)} {_TRAIN}",
    }


def for_spark() -> dict[str, str]:
    """The plain plan of three headline queries in Spark's SQL: every impression is joined with its
    actions, the pairs are ranked and collected. Work is quadratic per customer."""

    def training(base: str, days: int, k: int) -> str:
        return f"""WITH {base}, {_ranked(days, k)},
seq AS (SELECT rid, sort_array(collect_list(struct(rn, item_id, action_type))) AS entries FROM r GROUP BY rid)
SELECT i.dt, i.ranking_id, i.customer_id, i.impression_item_id, i.is_order,
       concat(coalesce(entries.item_id, array()), array_repeat(0, {k} - coalesce(size(entries), 0))) AS actions,
       concat(coalesce(entries.action_type, array()), array_repeat(0, {k} - coalesce(size(entries), 0))) AS action_types
FROM imp i LEFT JOIN seq ON i.rid = seq.rid"""

    def spark_sql(text: str) -> str:
        changes = {
            "props::json->>'k'": "get_json_object(props, '$.k')",
            "strftime(ts, '%Y-%m-%d')": "date_format(ts, 'yyyy-MM-dd')",
            "strftime(o_orderdate, '%Y-%m-%d')": "date_format(o_orderdate, 'yyyy-MM-dd')",
            "CAST(event_id AS VARCHAR)": "CAST(event_id AS STRING)",
            "CAST(o_orderkey AS VARCHAR)": "CAST(o_orderkey AS STRING)",
            "row_number() OVER () AS rid": "monotonically_increasing_id() AS rid",
            _IS_DAY.replace("dt", "i.dt"): "true",
            "CAST(try_cast(i.dt AS DATE) AS TIMESTAMP)": "CAST(i.dt AS TIMESTAMP_NTZ)",
        }
        for ours, theirs in changes.items():
            text = text.replace(ours, theirs)
        return text

    events = f"{_EVENTS}, {_EVENT_IMPRESSIONS}"
    return {
        "training_inputs_events": spark_sql(training(events, 7, 10)),
        "training_inputs_events_default_window": spark_sql(training(events, 365, 1000)),
        "training_inputs_orders": spark_sql(training(_ORDERS, 365, 20)),
    }
