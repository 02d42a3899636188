"""DuckDB SQL for the queries: each window joined to its rows by brute force."""

from __future__ import annotations

HOUR, DAY, ZONE = 3_600_000, 86_400_000, 28_800_000
_EVENTS = "SELECT event_id, (epoch_us(ts) // 1000) AS t, user_id, event_type, value, props, user_id::INT AS user_int FROM events"
_NULLS = f"SELECT * REPLACE (CASE WHEN event_id % 5 <> 0 THEN value END AS value, CASE WHEN event_id % 11 <> 0 THEN user_id END AS user_id) FROM ({_EVENTS})"
_BOUNDARY = f"SELECT * REPLACE (t - t % {HOUR} + CASE event_id % 4 WHEN 0 THEN -1 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE {HOUR - 1} END AS t) FROM ({_EVENTS})"
_TEXT = "strftime(make_timestamp(({0} + 28800) * 1000000), '%Y-%m-%d %H:%M:%S')"


def sod(ms: str) -> str:
    return f"({ms} - ({ms} + {ZONE}) % {DAY})"


AGG = {
    "count_4": "count(r.value)",
    "sum_4": "round(coalesce(sum(r.value), 0.0), 4)",
    "distinct_5": "count(DISTINCT r.props)",
    "distinct_int_6": "count(DISTINCT r.user_int)",
    "distinct_long_2": "count(DISTINCT r.user_id)",
}
FIELD = {"key_0_3": "g.event_type", "key_0_2": "g.user_id", "key_0": "g.event_type", "key_1_2": "g.user_id", "key": "g.event_type || ',' || g.user_id", "endtime_13": "g.w - 1", "starttime_13": "g.w - {size}", "endtime_10": "g.w // 1000 - 1", "starttime_10": "(g.w - {size}) // 1000", "endtime": _TEXT.format("g.w // 1000 - 1"), "starttime": _TEXT.format("(g.w - {size}) // 1000")}


def window_sql(group: list[str], fields: tuple[str, ...] = ("key_0_3", "endtime_13"), size: int = DAY, slide: int = HOUR, keys: tuple[str, ...] = ("event_type",), rows: str = _EVENTS, start_zero: bool = False, always: bool = True, keep_old: bool = False, trigger_late: int = 0, lateness: int = 0, agg: dict[str, str] = AGG, field: dict[str, str] = FIELD) -> str:
    split = size // slide
    reach = split * slide
    k = ", ".join(keys)
    day = f" AND {sod('(g.w - 1)')} <= r.p AND r.p <= {sod('(g.w - 1)')} + {DAY - slide}" if start_zero else ""
    last = f"(SELECT max(p) FROM kp) + {slide}" if keep_old else f"max(p) + {(split + 2) * slide}"
    island = "0" if keep_old else f"CASE WHEN f - lag(p) OVER (PARTITION BY {k} ORDER BY p) >= {(split + 2) * slide + lateness} THEN 1 ELSE 0 END"
    first = f"((min(f) + {trigger_late}) // {slide}) * {slide} + {slide}"
    changed = "" if always else f" WHERE EXISTS (SELECT 1 FROM kp WHERE {' AND '.join(f'kp.{x} = g0.{x}' for x in keys)} AND (kp.p + {slide} = g0.w OR kp.p + {reach + slide} = g0.w))"
    outs = [f"{field[f].format(size=size)} AS {f}" for f in fields] + [f"{agg[a]} AS {a}" for a in group]
    return f"""
WITH r0 AS ({rows}), r AS (SELECT *, t - t % {slide} AS p FROM r0),
kp AS (SELECT {k}, p, min(t) AS f FROM r GROUP BY {k}, p),
m AS (SELECT *, {island} AS n FROM kp),
i AS (SELECT *, sum(n) OVER (PARTITION BY {k} ORDER BY p) AS island FROM m),
g0 AS (SELECT {k}, unnest(range({first}, {last} + 1, {slide})) AS w FROM i GROUP BY {k}, island),
g AS (SELECT * FROM g0{changed})
SELECT {", ".join(outs)} FROM g LEFT JOIN r ON {" AND ".join(f"r.{x} = g.{x}" for x in keys)} AND r.p >= g.w - {reach} AND r.p < g.w{day}
GROUP BY {", ".join(f"g.{x}" for x in keys)}, g.w
"""


ALL = ["distinct_5", "distinct_int_6", "distinct_long_2", "count_4", "sum_4"]
_USERS = {"fields": ("key_0_2", "endtime_13"), "keys": ("user_id",)}
_DAY = {"size": 25 * HOUR, "start_zero": True}
_ARRIVAL = f"SELECT *, t + CASE WHEN event_id % 97 = 0 THEN 93600000 WHEN event_id % 7 = 0 THEN 1200000 ELSE 0 END AS arrival FROM ({_EVENTS})"
_TICK = f"SELECT *, arrival - arrival % {HOUR} + {HOUR} AS tick FROM ({_ARRIVAL})"
_ADMITTED = f"SELECT * FROM ({_TICK}) WHERE NOT (tick - t > {HOUR} AND {sod('tick')} > {sod('t')})"
_REVISIONS = f"""
WITH r AS (SELECT *, t - t % {HOUR} AS p, {sod('t')} AS d FROM ({_ADMITTED})),
o AS (SELECT DISTINCT event_type, d, p + {HOUR} AS w, p + {HOUR} AS tick FROM r),
a AS (SELECT event_type, d, unnest(range(p + {HOUR}, least(d + {DAY}, tick) + 1, {HOUR})) AS w, tick FROM r WHERE tick > p + {HOUR}),
e AS (SELECT event_type, d, w, tick FROM o UNION SELECT event_type, d, w, tick FROM a),
v AS (
  SELECT e.event_type, e.w AS "end", e.tick, count(r.value) AS n, round(coalesce(sum(r.value), 0.0), 4) AS total, count(DISTINCT r.user_id) AS users
  FROM e LEFT JOIN r ON r.event_type = e.event_type AND r.d = e.d AND r.p < e.w AND greatest(r.tick, r.p + {HOUR}) <= e.tick GROUP BY ALL
)
"""
_DUP = """
SELECT event_type || ':hash' AS hkey, CAST(event_id // 2 AS VARCHAR) AS field,
  event_type || ',' || user_id || ',' || (epoch_us(ts) // 1000) || ',' || props AS value, event_id FROM events
"""


def _resolved(pick: str, rows: str = _DUP) -> str:
    return f"SELECT hkey, field, {pick}(value, event_id) AS value FROM ({rows}) GROUP BY hkey, field"


def _retracted(group: list[str], **kw) -> str:
    """Rows that are taken back count for the grid and for nothing else."""
    agg = {a: s.replace("r.value", "(CASE WHEN r.event_id % 13 <> 0 THEN r.value END)").replace("r.user_id", "(CASE WHEN r.event_id % 13 <> 0 THEN r.user_id END)").replace("r.props", "(CASE WHEN r.event_id % 13 <> 0 THEN r.props END)") for a, s in AGG.items()}
    return window_sql(group, agg=agg, **kw)


_CHAIN = f"SELECT key_0_3 AS event_type, endtime_13 AS t, count_4 FROM ({window_sql(['count_4'], size=HOUR)})"

ORACLE: dict[str, str] = {
    "tumbling_count_sum": window_sql(["count_4", "sum_4"], size=HOUR),
    "sliding_count": window_sql(["count_4"]),
    "sliding_sum": window_sql(["sum_4"]),
    "sliding_distinct_string": window_sql(["distinct_5"]),
    "sliding_distinct_int": window_sql(["distinct_int_6"]),
    "sliding_distinct_long": window_sql(["distinct_long_2"]),
    "sliding_multi_agg": window_sql(ALL),
    "sliding_composite_key": window_sql(["count_4", "distinct_5"], ("key_0_3", "key_1_2", "endtime_13"), keys=("event_type", "user_id")),
    "sliding_nondivisible": window_sql(["count_4", "sum_4", "distinct_long_2"], ("key_0_3", "starttime_13", "endtime_13"), 7 * HOUR, 2 * HOUR),
    "sliding_25h_1min": window_sql(["count_4", "distinct_long_2"], size=25 * HOUR, slide=60_000),
    "day_cumulative_count_sum": window_sql(["count_4", "sum_4"], **_DAY),
    "day_cumulative_distinct": window_sql(["distinct_5", "distinct_long_2"], **_DAY),
    "day_cumulative_short": window_sql(["count_4", "sum_4", "distinct_long_2"], size=6 * HOUR, start_zero=True),
    "emit_on_change": window_sql(["count_4", "sum_4", "distinct_long_2"], size=3 * HOUR, **_USERS, always=False),
    "always_calculate_grid": window_sql(["count_4", "sum_4"], size=3 * HOUR, **_USERS),
    "idle_key_islands": window_sql(["count_4", "distinct_long_2"], size=6 * HOUR, **_USERS),
    "keep_old_data": window_sql(["count_4", "distinct_long_2"], size=6 * HOUR, **_USERS, keep_old=True),
    "field_formats": window_sql(["count_4"], ("key", "key_0", "starttime", "starttime_10", "starttime_13", "endtime", "endtime_10", "endtime_13"), 2 * HOUR, keys=("event_type", "user_id")),
    "select_where": f"SELECT key_0_3 AS event_type, endtime_13, count_4 AS n, sum_4 AS total FROM ({window_sql(['count_4', 'sum_4'])}) WHERE count_4 > 50",
    "parse_time_forms": f"""
SELECT event_id, ms, strftime(make_timestamp((ms // 1000 + 28800) * 1000000), '%Y-%m-%d %H:%M:%S') AS formatted,
  strftime(make_timestamp((ms // 1000 + 28800) * 1000000), '%Y-%m-%d') AS day, {sod('ms')} AS day_start, {sod('ms')} + {DAY - HOUR} AS last_pane
FROM (SELECT event_id, CASE WHEN event_id % 4 = 1 THEN (epoch_us(ts) // 1000) ELSE (epoch_us(ts) // 1000) // 1000 * 1000 END AS ms FROM events)
""",
    "json_tokenizer": "SELECT event_type AS c1, user_id::INT AS c2, user_id AS c3, event_id::VARCHAR AS c4, (epoch_us(ts) // 1000) AS c5 FROM events WHERE event_id % 50 <> 0",
    "null_handling": window_sql(["count_4", "sum_4", "distinct_long_2"], rows=_NULLS),
    "detail_build": """
SELECT event_type || ':hash' AS hkey, event_id::VARCHAR AS field,
  event_type || ',' || user_id || ',' || strftime(ts, '%Y-%m-%d %H:%M:%S') ||
    CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad((microsecond(ts) % 1000000)::VARCHAR, 6, '0'), '0') END || ',' || value AS value FROM events
""",
    "detail_first_write": _resolved("arg_min"),
    "detail_last_write": _resolved("arg_max"),
    "detail_check_exists": f"""
WITH a AS ({_resolved("arg_max", f"SELECT * FROM ({_DUP}) WHERE event_id % 3 = 0")}), b AS ({_resolved("arg_min")})
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.hkey = b.hkey AND a.field = b.field)
""",
    "detail_audit": f"SELECT '2024-01-02' AS date, '2024-01-02 01:00:00' AS datetime, * FROM ({_resolved('arg_max')})",
    "retract_count_sum": _retracted(["count_4", "sum_4"]),
    "retract_distinct": _retracted(["distinct_long_2", "distinct_5"]),
    "late_recount": window_sql(["count_4", "sum_4", "distinct_long_2"], rows=_ADMITTED, **_DAY),
    "late_revisions": _REVISIONS + "SELECT * FROM v",
    "late_upsert": _REVISIONS + 'SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY event_type, "end" ORDER BY tick DESC) = 1',
    "midnight_cutoff": f"SELECT event_type, {sod('t')} AS day, count(*) AS n FROM ({_ADMITTED}) GROUP BY ALL",
    "trigger_late_first_tick": window_sql(["count_4", "sum_4"], trigger_late=5 * HOUR),
    "boundary": window_sql(["count_4", "sum_4", "distinct_long_2"], size=6 * HOUR, rows=_BOUNDARY),
    "boundary_day": window_sql(["count_4", "sum_4", "distinct_long_2"], rows=_BOUNDARY, **_DAY),
    "legacy_window": window_sql(ALL, size=6 * HOUR, rows=f"SELECT * REPLACE (CASE WHEN event_id % 3 <> 0 THEN props END AS props) FROM ({_NULLS})", trigger_late=HOUR, agg=AGG | {"distinct_5": "count(DISTINCT r.props) + coalesce(max((r.t IS NOT NULL AND r.props IS NULL)::INT), 0)"}),
    "lateness_and_trigger": window_sql(["count_4", "sum_4", "distinct_long_2"], size=6 * HOUR, trigger_late=90 * 60_000, lateness=30 * 60_000, **_USERS),
    "buffer_chain": window_sql(
        ["count_2", "sum_2"], ("key_0", "endtime_13"), 6 * HOUR, rows=_CHAIN, agg={"count_2": "count(r.count_4)", "sum_2": "round(coalesce(sum(r.count_4::DOUBLE), 0.0), 4)"}
    ),
    "bitmap_distinct": f"SELECT event_type, {sod('(epoch_us(ts) // 1000)')} AS day, count(DISTINCT user_id) AS n_distinct FROM events GROUP BY ALL",
    "lineitem_daily_distinct_supplier": window_sql(
        ["distinct_long_2", "count_3", "sum_3"],
        ("key_0_0", "endtime_13"),
        30 * DAY,
        DAY,
        keys=("l_returnflag",),
        rows="SELECT l_returnflag, (epoch_us(l_shipdate) // 1000) AS t, l_suppkey, l_quantity FROM lineitem",
        agg={"distinct_long_2": "count(DISTINCT r.l_suppkey)", "count_3": "count(r.l_quantity)", "sum_3": "round(coalesce(sum(r.l_quantity), 0.0), 4)"},
        field={"key_0_0": "g.l_returnflag", "endtime_13": "g.w - 1"},
    ),
    "window_job": f"SELECT * FROM ({window_sql(['count_4', 'sum_4', 'distinct_long_2'], rows=_ADMITTED, **_DAY)}) WHERE count_4 > 0",
    "stream_job": f"SELECT * FROM ({window_sql(['count_4', 'sum_4', 'distinct_long_2'], trigger_late=2 * HOUR, **_DAY)}) WHERE count_4 > 0",
    "detail_job": f"""
WITH a AS ({_resolved("arg_min", f"SELECT * FROM ({_DUP}) WHERE event_id % 3 = 0")}), b AS ({_resolved("arg_min")})
SELECT * FROM a UNION ALL SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.hkey = b.hkey AND a.field = b.field)
""",
    "stream_equals_batch": window_sql(["count_4", "sum_4", "distinct_long_2"]),
    "stream_late_recount": window_sql(["count_4", "sum_4", "distinct_long_2"], rows=_ADMITTED, **_DAY),
    "stream_lateness": window_sql(["count_4", "sum_4", "distinct_long_2"], size=6 * HOUR, trigger_late=90 * 60_000, lateness=30 * 60_000),
    "stream_retraction": _retracted(["count_4", "sum_4", "distinct_long_2"], **_DAY),
}
