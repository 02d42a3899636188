"""The two jobs: parameters in, tables out.

A parameter is honoured or refused. The job is a batch over a table, or, with ``streaming``, a query that runs
on from the checkpoint of its ``uid``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidewheel.operators import detail, replay, retract, windows
from tidewheel.plans.config import DetailConfig, JobConfig
from tidewheel.sources import tables
from tidewheel.streaming.processor import revised_stream

#: Makes a store from address, port and password.
Connect = Callable[[str, int, str | None], detail.DetailStore]


def run_window_job(spark: SparkSession, params: dict[str, str], connect: Connect | None = None, arrival: str | None = None) -> DataFrame:
    """Window a table by its parameters, apply select and where, and write or register the result.

    Details for a retraction come from ``detail.table`` or from the store that ``connect`` opens at
    ``redis.address``. ``arrival`` names a column of epoch milliseconds at which rows came in: late rows are then
    held against ``lateness`` and ``keep.late.zero.time`` and recounted. Without it a table has no late rows, so these
    and ``recount.late.data`` change nothing; the state parameters are a stream's and are refused.
    """
    job = JobConfig.from_params(params)
    if job.idle_state_s:
        raise ValueError("min.idle.state and max.idle.state are for streaming jobs")
    if job.time_type == "processing":
        raise ValueError("a table has no processing time; stream.time.type is for streaming jobs")
    df = tables.input_table(spark, job.input_table)
    if job.window.retraction:
        out = retract.retracted(df, _details(spark, job, connect), job.window)
    elif arrival:
        if not job.window.recount:
            raise ValueError("without recount.late.data late rows change what is given after them only; that needs a streaming job")
        out = replay.final(df, job.window, arrival)
    else:
        out = windows.windowed(df, job.window)
    if arrival and arrival in out.columns:
        out = out.drop(arrival)
    out = tables.finish(out, job.select, job.where)
    tables.output_table(out, job.output_table, job.output_type)
    return out


def _details(spark: SparkSession, job: JobConfig, connect: Connect | None) -> DataFrame:
    if job.detail_table:
        return spark.table(job.detail_table)
    if not job.store_address or connect is None:
        raise ValueError("hkey.value.map needs detail.table, or redis.address and a way to connect")
    return connect(job.store_address, job.store_port, job.store_password).read().select("hkey", "field", "value")


def start_window_job(
    spark: SparkSession, params: dict[str, str], checkpoints: str, source: DataFrame | None = None, arrival: str | None = None, sign: str | None = None, delay: str = "0 seconds",
    upsert: tables.Upsert | None = None, available_now: bool = False,
) -> StreamingQuery:
    """The window job as a stream into a table, to which each emission of a window is appended, revisions too.

    With ``upsert`` the emissions go there instead, as (keys, end, aggregates, tick); ``last_windows`` reads the last of
    each window. ``uid`` names the query and its checkpoint under ``checkpoints``: a job that is started again goes on
    where it stopped. ``source`` stands for a stream that isn't in the catalog. Retractions come in the stream itself,
    as rows with ``sign`` -1. ``max.idle.state`` bounds the state of a key without rows; with processing time it is the
    state's time to live.
    """
    job = JobConfig.from_params(params)
    if job.output_type != "sink":
        raise ValueError("a streaming job writes to a sink; a buffer is a view of a batch")
    if job.window.retraction or job.store_address:
        raise ValueError("a stream takes retractions as signed rows, not by hkey.value.map and redis.address")
    df = tables.coerce_times(source) if source is not None else tables.input_table(spark, job.input_table, streaming=True)
    idle = job.idle_state_s[1] * 1000 if job.idle_state_s else None
    done = revised_stream(df, job.window, arrival, sign, job.time_type == "processing", delay, idle)
    writer = done if upsert else tables.finish(windows.output(done, job.window), job.select, job.where)
    writer = writer.writeStream.queryName(job.uid).option("checkpointLocation", f"{checkpoints.rstrip('/')}/{job.uid}")
    writer = writer.trigger(availableNow=True) if available_now else writer
    return writer.foreachBatch(upsert).start() if upsert else writer.toTable(job.output_table)


def last_windows(spark: SparkSession, params: dict[str, str], upsert: tables.Upsert) -> DataFrame:
    """The last emission of each window of a streaming job, with its select and where."""
    job = JobConfig.from_params(params)
    return tables.finish(windows.output(upsert.read(spark), job.window), job.select, job.where)


def run_detail_job(spark: SparkSession, params: dict[str, str], store: detail.DetailStore | Connect, order: str) -> DataFrame:
    """Write the details of a table's rows; ``order`` is the column that tells earlier from later rows."""
    cfg = DetailConfig.from_params(params)
    if not isinstance(store, detail.DetailStore):
        store = store(params["redis.address"], int(params.get("redis.port", 9100)), params.get("redis.passwd"))
    out = detail.write_details(tables.input_table(spark, params["input.table.name"]), cfg, store, order)
    if params.get("output.table.name"):
        tables.output_table(out, params["output.table.name"], params.get("output.table.type", "sink"))
    return out
