"""One query for each operator of the window engine over the driver's tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel import job
from tidewheel.functions import timeutil
from tidewheel.operators import detail, replay, retract, windows
from tidewheel.plans.config import DetailConfig, GroupSchema, Retraction, WindowConfig
from tidewheel.sources import tables
from tidewheel.sources.shared import shared_folder

HOUR, DAY = 3_600_000, 86_400_000
Query = Callable[[SparkSession, str], DataFrame]


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, event_type, value, props and, appended, user_id as an int."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    e = tables.coerce_times(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return e.select("event_id", "ts", "user_id", "event_type", "value", "props", F.col("user_id").cast("int").alias("user_int"))


def config(group: list[str], fields: tuple[str, ...] = ("key_0_3", "endtime_13"), size: int = DAY, slide: int = HOUR, keys: tuple[int, ...] = (3,), **more) -> WindowConfig:
    return WindowConfig(keys, 1, size, slide, GroupSchema.parse(json.dumps({"field": list(fields), "group": group})), **more)


def rounded(df: DataFrame) -> DataFrame:
    """Sums to four decimals: the order of additions is not fixed."""
    return df.select(*[F.round(F.col(f"`{c}`"), 4).alias(c) if c.startswith("sum_") else F.col(f"`{c}`") for c in df.columns])


def window_query(make: Callable[[DataFrame], DataFrame] = lambda e: e, **kw) -> Query:
    return lambda s, d: rounded(windows.windowed(make(events(s, d)), config(**kw)))


def nulls(e: DataFrame) -> DataFrame:
    return e.withColumn("value", F.when(F.col("event_id") % 5 != 0, F.col("value"))).withColumn("user_id", F.when(F.col("event_id") % 11 != 0, F.col("user_id")))


def boundary(e: DataFrame) -> DataFrame:
    """Every row a millisecond ahead of a full hour, at it, a millisecond after it or at the hour's end."""
    ms = F.unix_millis("ts")
    step = F.when(F.col("event_id") % 4 == 0, -1).when(F.col("event_id") % 4 == 1, 0).when(F.col("event_id") % 4 == 2, 1).otherwise(HOUR - 1)
    return e.withColumn("ts", F.timestamp_millis(ms - ms % HOUR + step))


def late(e: DataFrame) -> DataFrame:
    """Appends arrival: some rows come 20 minutes late, a few a day and two hours."""
    ms = F.unix_millis("ts")
    delay = F.when(F.col("event_id") % 97 == 0, 93_600_000).when(F.col("event_id") % 7 == 0, 1_200_000).otherwise(0)
    return e.withColumn("arrival", ms + delay)


#: Users have idle hours, event types have none.
USERS = {"fields": ("key_0_2", "endtime_13"), "keys": (2,)}
DAY_CONFIG = {"size": 25 * HOUR, "start_zero": True, "keep_late_zero": HOUR}


def _select_where(s: SparkSession, d: str) -> DataFrame:
    out = windows.windowed(events(s, d), config(["count_4", "sum_4"]))
    return tables.finish(out, "key_0_3 AS event_type, endtime_13, count_4 AS n, round(sum_4, 4) AS total", "count_4 > 50")


def _buffer_chain(s: SparkSession, d: str) -> DataFrame:
    first = windows.windowed(events(s, d), config(["count_4"], ("key_0_3", "endtime_13"), HOUR, HOUR))
    tables.output_table(first, "tidewheel_hourly", "buffer")
    again = WindowConfig((0,), 1, 6 * HOUR, HOUR, GroupSchema.parse('{"field":["key_0","endtime_13"],"group":["count_2","sum_2"]}'))
    return rounded(windows.windowed(tables.input_table(s, "tidewheel_hourly"), again))


def _times(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    ms, form = F.unix_millis("ts"), F.col("event_id") % 4
    local = F.timestamp_millis(ms + 8 * HOUR)
    text = F.when(form == 0, F.floor(ms / 1000).cast("string")).when(form == 1, ms.cast("string"))
    text = text.when(form == 2, F.date_format(local, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(local, "yyyy-MM-dd HH:mm:ss.SSS"))
    t = e.select("event_id", text.alias("text"))
    parsed = timeutil.parse_ms(F.col("text"), t.schema["text"].dataType)
    return t.select("event_id", parsed.alias("ms"), timeutil.format_text(F.floor(parsed / 1000)).alias("formatted"), timeutil.format_day(F.floor(parsed / 1000)).alias("day"), timeutil.day_start(parsed).alias("day_start"), timeutil.last_pane(parsed, HOUR).alias("last_pane"))


def _tokenizer(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    row = F.struct(F.col("event_type").alias("c1"), F.col("user_int").alias("c2"), F.col("user_id").alias("c3"), F.col("event_id").cast("string").alias("c4"), F.unix_millis("ts").alias("c5"))
    text = F.when(F.col("event_id") % 50 == 0, F.lit("{not json")).otherwise(F.to_json(row))
    t = tables.tokenize(e.select(text.alias("value")))
    return t.withColumn("c5", F.unix_millis("c5"))


DETAIL = DetailConfig("field_3", 0, (3, 2, 1, 4), ":hash")


def _dup_pk(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return e.select(F.floor(F.col("event_id") / 2).cast("string").alias("pk"), F.unix_millis("ts").alias("ms"), "user_id", "event_type", "event_id", "props")


DUP = DetailConfig("field_3", 0, (3, 2, 1, 5), ":hash")


def _details(s: SparkSession, d: str, first: bool) -> DataFrame:
    return detail.resolve(detail.build(_dup_pk(s, d), DUP, "event_id"), first)


def _detail_store(s: SparkSession, d: str) -> DataFrame:
    """Two batches into a store, the second only where a field is absent."""
    rows = _dup_pk(s, d)
    store = detail.DetailStore(s, shared_folder(s, "details"))
    with store:
        detail.write_details(rows.filter("event_id % 3 = 0"), DUP, store, "event_id")
        detail.write_details(rows, DetailConfig("field_3", 0, (3, 2, 1, 5), ":hash", check_exists=True), store, "event_id")
    return store.read().select("hkey", "field", "value")


def _detail_job(s: SparkSession, d: str) -> DataFrame:
    """The detail job by its parameters: existing details stay, what is written comes out."""
    rows = _dup_pk(s, d)
    store = detail.DetailStore(s, shared_folder(s, "details"))
    params = {"input.table.name": "tidewheel_details", "hkey.prefix": "field_3", "hkey.suffix": ":hash", "hkey.field": "0", "hkey.values": "3,2,1,5", "check.exists": "true", "redis.expire": "86400"}
    for part in (rows.filter("event_id % 3 = 0"), rows):
        part.createOrReplaceTempView("tidewheel_details")
        job.run_detail_job(s, params, store, "event_id")
    return store.read().select("hkey", "field", "value")


def _audit(s: SparkSession, d: str) -> DataFrame:
    built = detail.resolve(detail.build(_dup_pk(s, d), DUP, "event_id"), False)
    return detail.audit(built, F.lit(1_704_067_200 + 17 * 3600).cast("long"))


RETRACT = Retraction("held", "", 0, 2, ((0, 3), (1, 3), (2, 1), (3, 4)))


def _retract(s: SparkSession, d: str, group: list[str], **kw) -> DataFrame:
    e = events(s, d)
    spec = DetailConfig("held", 0, (3, 2, 7, 4, 5))
    gone = e.withColumn("ms", F.unix_millis("ts")).filter("event_id % 13 = 0")
    details = detail.resolve(detail.build(gone, spec, "event_id"), False)
    cfg = config(group, retraction=kw.pop("spec"), **kw)
    return rounded(retract.retracted(e, details, cfg))


def _late(s: SparkSession, d: str) -> DataFrame:
    return rounded(replay.final(late(events(s, d)), config(["count_4", "sum_4", "distinct_long_2"], **DAY_CONFIG), "arrival"))


def _cutoff(s: SparkSession, d: str) -> DataFrame:
    r = replay.admitted(late(events(s, d)), config(["count_4"], **DAY_CONFIG), "arrival")
    return r.groupBy("_k0", timeutil.day_start(F.col("t")).alias("day")).agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("_k0", "event_type")


def _revisions(s: SparkSession, d: str, last: bool) -> DataFrame:
    cfg = config(["count_4", "sum_4", "distinct_long_2"], **DAY_CONFIG)
    out = replay.revisions(late(events(s, d)), cfg, "arrival")
    out = replay.latest(out, ["_k0"]) if last else out
    return out.select(F.col("_k0").alias("event_type"), "end", "tick", F.col("_a0").alias("n"), F.round("_a1", 4).alias("total"), F.col("_a2").alias("users"))


def _bitmap(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d).withColumn("day", timeutil.day_start(F.unix_millis("ts")))
    return windows.bitmap_distinct(e, ["event_type", "day"], "user_id")


def _lineitem(s: SparkSession, d: str) -> DataFrame:
    s.conf.set("spark.sql.session.timeZone", "UTC")
    t = tables.coerce_times(s.read.parquet(f"{d}/lineitem.parquet")).select("l_returnflag", "l_shipdate", "l_suppkey", "l_quantity")
    cfg = WindowConfig((0,), 1, 30 * DAY, DAY, GroupSchema.parse('{"field":["key_0_0","endtime_13"],"group":["distinct_long_2","count_3","sum_3"]}'))
    return rounded(windows.windowed(t, cfg))


STREAM = {"group": ["count_4", "sum_4", "distinct_long_2"], "fields": ("key_0_3", "endtime_13"), "size": DAY, "slide": HOUR}


def streamed(rows: DataFrame, cfg: WindowConfig, clock: str, sign: str | None = None) -> DataFrame:
    """(keys, end, aggregates, tick): all that the stream operator gives for ``rows``, which come in by ``clock``.

    The rows are written in stretches of time; after each the query runs on from its checkpoint until all is
    read. The last stretch is one row of the key ``~`` long after all others, whose time lets the timers fire.
    """
    from tidewheel.streaming.processor import revised_stream

    s = rows.sparkSession
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    folder = shared_folder(s, "stream")
    low, high = rows.agg(F.min(clock), F.max(clock)).first()
    if low is None:
        low = high = 0
    stretch = F.least(F.floor((F.col(clock) - low) * 2 / (high - low + 1)), F.lit(1))
    key = rows.columns[cfg.key_fields[0]]
    after = high + 2 * cfg.reach + cfg.lateness + 90 * DAY
    last = s.range(1).select(*[
        F.lit("~").alias(f.name) if f.name == key else F.lit(after).alias(f.name) if f.name == clock
        else F.timestamp_millis(F.lit(after)).alias(f.name) if f.name == rows.columns[cfg.time_field]
        else F.lit(1).alias(f.name) if f.name == sign else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema
    ])

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={epoch}")

    for part in [*[rows.filter(stretch == i) for i in range(2)], last]:
        part.write.mode("append").parquet(f"{folder}/in")
        source = s.readStream.schema(rows.schema).parquet(f"{folder}/in")
        done = revised_stream(source, cfg, clock=clock, sign=sign).filter("_k0 != '~'")
        done.writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(f"{folder}/out").drop("batch")


def _stream(s: SparkSession, d: str, make: Callable[[DataFrame], DataFrame], sign: str | None = None, **kw) -> DataFrame:
    """The last revision of every window that the stream gives, in the form of the batch query."""
    cfg = config(**kw)
    return rounded(windows.output(replay.latest(streamed(make(events(s, d)), cfg, "arrival", sign), ["_k0"]), cfg))


PARAMS = {
    "input.table.name": "tidewheel_events", "output.table.name": "tidewheel_windows", "output.table.type": "buffer", "window.size": str(25 * HOUR), "slide.size": str(HOUR), "time.field": "1", "key.fields": "3",
    "group.string": '{"field":["key_0_3","endtime_13"],"group":["count_4","sum_4","distinct_long_2"]}', "start.zero.time": "true", "keep.late.zero.time": str(HOUR), "recount.late.data": "true",
    "select": "key_0_3, endtime_13, count_4, round(sum_4, 4) AS sum_4, distinct_long_2", "where": "count_4 > 0",
}


def _window_job(s: SparkSession, d: str) -> DataFrame:
    """The window job by its parameters: late rows recounted in day mode."""
    late(events(s, d)).createOrReplaceTempView(PARAMS["input.table.name"])
    return job.run_window_job(s, PARAMS | {"input.table.type": "buffer"}, arrival="arrival")


def _stream_job(s: SparkSession, d: str) -> DataFrame:
    """The streaming window job, stopped and started again in between; the last emission of each window."""
    folder = shared_folder(s, "job")
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = on_time(events(s, d))
    upsert = tables.Upsert(f"{folder}/windows", ["_k0", "end"], "tick")
    params = PARAMS | {"output.table.type": "sink", "uid": "tidewheel", "keep.old.data": "true", "trigger.late.ms": str(2 * HOUR)}
    low, high = rows.agg(F.min("arrival"), F.max("arrival")).first()
    middle = ((low or 0) + (high or 0)) // 2
    end = s.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.timestamp_millis(F.lit((high or 0) + 2 * DAY)).alias("ts"), F.lit("~").alias("event_type"), F.lit((high or 0) + 2 * DAY).alias("arrival"))
    for part in (rows.filter(F.col("arrival") <= middle), rows.filter(F.col("arrival") > middle), end):
        s.createDataFrame([], rows.schema).unionByName(part, allowMissingColumns=True).write.mode("append").parquet(f"{folder}/in")
        source = s.readStream.schema(rows.schema).parquet(f"{folder}/in")
        job.start_window_job(s, params, f"{folder}/state", source, "arrival", upsert=upsert, available_now=True).awaitTermination()
    return job.last_windows(s, params, upsert).filter("key_0_3 <> '~'")


def on_time(e: DataFrame) -> DataFrame:
    return e.withColumn("arrival", F.unix_millis("ts"))


def taken_back(e: DataFrame) -> DataFrame:
    """All rows on time, and every 13th once more two hours later with the sign of a retraction."""
    back = e.filter("event_id % 13 = 0").withColumn("arrival", F.unix_millis("ts") + 2 * HOUR).withColumn("sign", F.lit(-1))
    return on_time(e).withColumn("sign", F.lit(1)).unionByName(back)


STREAM = {"group": ["count_4", "sum_4", "distinct_long_2"]}


ALL = ["distinct_5", "distinct_int_6", "distinct_long_2", "count_4", "sum_4"]
QUERIES: dict[str, Query] = {
    "tumbling_count_sum": window_query(group=["count_4", "sum_4"], size=HOUR, slide=HOUR),
    "sliding_count": window_query(group=["count_4"]),
    "sliding_sum": window_query(group=["sum_4"]),
    "sliding_distinct_string": window_query(group=["distinct_5"]),
    "sliding_distinct_int": window_query(group=["distinct_int_6"]),
    "sliding_distinct_long": window_query(group=["distinct_long_2"]),
    "sliding_multi_agg": window_query(group=ALL),
    "sliding_composite_key": window_query(group=["count_4", "distinct_5"], fields=("key_0_3", "key_1_2", "endtime_13"), keys=(3, 2)),
    "sliding_nondivisible": window_query(group=["count_4", "sum_4", "distinct_long_2"], fields=("key_0_3", "starttime_13", "endtime_13"), size=7 * HOUR, slide=2 * HOUR),
    "sliding_25h_1min": window_query(group=["count_4", "distinct_long_2"], size=25 * HOUR, slide=60_000),
    "day_cumulative_count_sum": window_query(group=["count_4", "sum_4"], **{**DAY_CONFIG, "keep_late_zero": 0}),
    "day_cumulative_distinct": window_query(group=["distinct_5", "distinct_long_2"], **{**DAY_CONFIG, "keep_late_zero": 0}),
    "day_cumulative_short": window_query(group=["count_4", "sum_4", "distinct_long_2"], size=6 * HOUR, slide=HOUR, start_zero=True),
    "emit_on_change": window_query(group=["count_4", "sum_4", "distinct_long_2"], size=3 * HOUR, slide=HOUR, always=False, **USERS),
    "always_calculate_grid": window_query(group=["count_4", "sum_4"], size=3 * HOUR, slide=HOUR, **USERS),
    "idle_key_islands": window_query(group=["count_4", "distinct_long_2"], size=6 * HOUR, slide=HOUR, **USERS),
    "keep_old_data": window_query(group=["count_4", "distinct_long_2"], size=6 * HOUR, slide=HOUR, keep_old=True, **USERS),
    "field_formats": window_query(group=["count_4"], fields=("key", "key_0", "starttime", "starttime_10", "starttime_13", "endtime", "endtime_10", "endtime_13"), keys=(3, 2), size=2 * HOUR, slide=HOUR),
    "select_where": _select_where,
    "parse_time_forms": _times,
    "json_tokenizer": _tokenizer,
    "null_handling": window_query(nulls, group=["count_4", "sum_4", "distinct_long_2"]),
    "detail_build": lambda s, d: detail.build(events(s, d), DETAIL),
    "detail_first_write": lambda s, d: _details(s, d, True),
    "detail_last_write": lambda s, d: _details(s, d, False),
    "detail_check_exists": _detail_store,
    "detail_audit": _audit,
    "retract_count_sum": lambda s, d: _retract(s, d, ["count_4", "sum_4"], spec=RETRACT),
    "retract_distinct": lambda s, d: _retract(s, d, ["distinct_long_2", "distinct_5"], spec=Retraction("held", "", 0, 2, ((0, 1), (1, 4)))),
    "late_recount": _late,
    "late_revisions": lambda s, d: _revisions(s, d, False),
    "late_upsert": lambda s, d: _revisions(s, d, True),
    "midnight_cutoff": _cutoff,
    "trigger_late_first_tick": window_query(group=["count_4", "sum_4"], trigger_late=5 * HOUR),
    "boundary": window_query(boundary, group=["count_4", "sum_4", "distinct_long_2"], size=6 * HOUR),
    "boundary_day": window_query(boundary, group=["count_4", "sum_4", "distinct_long_2"], **DAY_CONFIG),
    "legacy_window": lambda s, d: rounded(windows.legacy_windowed(nulls(events(s, d)).withColumn("props", F.when(F.col("event_id") % 3 != 0, F.col("props"))), config(ALL, size=6 * HOUR))),
    "lateness_and_trigger": window_query(group=["count_4", "sum_4", "distinct_long_2"], size=6 * HOUR, slide=HOUR, trigger_late=90 * 60_000, lateness=30 * 60_000, **USERS),
    "buffer_chain": _buffer_chain,
    "bitmap_distinct": _bitmap,
    "lineitem_daily_distinct_supplier": _lineitem,
    "window_job": _window_job,
    "detail_job": _detail_job,
    "stream_job": _stream_job,
    "stream_equals_batch": lambda s, d: _stream(s, d, on_time, **STREAM),
    "stream_late_recount": lambda s, d: _stream(s, d, late, **STREAM, **DAY_CONFIG),
    "stream_lateness": lambda s, d: _stream(s, d, on_time, **STREAM, lateness=30 * 60_000, size=6 * HOUR, trigger_late=90 * 60_000),
    "stream_retraction": lambda s, d: _stream(s, d, taken_back, "sign", **STREAM, **DAY_CONFIG),
}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day by an hour: users, rows and their sum for each event type."""
    return rounded(windows.windowed(events(spark, sf_dir), config(["distinct_long_2", "count_4", "sum_4"], ("key_0_3", "endtime"))))
