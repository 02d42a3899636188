"""Late data: replay of rows by arrival, revisions of earlier windows, and the midnight cutoff.

A row's tick is the first window end after its arrival less the lateness. A window that ends at ``end`` is
first given at the tick ``end`` and again at each tick at which a late row of its day came in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.timeutil import DAY_MS, day_start, floor_to, windows_after
from tidewheel.operators import windows as W
from tidewheel.plans.config import WindowConfig


def tick(arrival: Column, cfg: WindowConfig) -> Column:
    return floor_to(arrival - cfg.lateness, cfg.slide) + cfg.slide


def admitted(df: DataFrame, cfg: WindowConfig, arrival: str) -> DataFrame:
    """Rows with key columns, pane and tick, without those too late for their day."""
    r = W.rows(df, cfg, [F.col(arrival).alias("_arrival")]).withColumn("tick", tick(F.col("_arrival"), cfg))
    if not cfg.start_zero:
        return r
    late = (F.col("tick") - F.col("t") > cfg.late_limit) & (day_start(F.col("tick"), cfg.zone_ms) > day_start(F.col("t"), cfg.zone_ms))
    return r.filter(~late)


def final(df: DataFrame, cfg: WindowConfig, arrival: str) -> DataFrame:
    """The last revision of every window (an upsert on key and end) in day-cumulative mode.

    Every admitted row revises all later windows of its day, so the last revision holds all of them.
    """
    return W.output(W.compute(admitted(df, cfg, arrival), cfg), cfg)


def revisions(df: DataFrame, cfg: WindowConfig, arrival: str) -> DataFrame:
    """(keys, end, tick, aggregates): every emission of every window that holds rows, in day mode.

    The first emission of a window holds the rows whose tick is not after its end: a running sum over the ticks
    of a day. A later one adds what came in at its tick, of panes ahead of the end: a running sum over the
    ends that the tick gives again. A window's revisions are the running sum of both over its ticks. A distinct
    value is in a window from the first tick of its panes ahead of the end on, so it adds to one emission
    of each window. No step joins on a range, and none holds a day's values in one row.
    """
    if not cfg.start_zero or cfg.size < DAY_MS:
        raise ValueError("revisions are kept for day-cumulative windows")
    aggs, slide = cfg.group.aggregates, cfg.slide
    keys = [f"_k{i}" for i in range(len(cfg.key_fields))]
    by = [*keys, "day"]
    r = admitted(df, cfg, arrival).withColumn("day", day_start(F.col("pane"), cfg.zone_ms))
    r = r.filter(F.col("day") == day_start(F.col("pane") + slide - 1, cfg.zone_ms))
    # A tick is never ahead of the row's own window.
    r = r.withColumn("tick", F.greatest("tick", F.col("pane") + slide))
    late = F.col("tick") > F.col("pane") + slide

    own = r.select(*by, (F.col("pane") + slide).alias("end")).distinct().withColumn("tick", F.col("end"))
    again = r.filter(late).groupBy(*by, "tick").agg(F.min("pane").alias("pane"))
    again = again.select(*by, F.explode(windows_after(F.col("pane"), slide, F.col("tick"), cfg.zone_ms)).alias("end"), "tick")
    emitted = own.unionByName(again).distinct()

    def zero(n: int) -> Column:
        return F.lit(0.0) if aggs[n].fn == "sum" else F.lit(0).cast("long")

    def part(rows: DataFrame, tick: Column, at: Column, have: dict[int, Column]) -> DataFrame:
        return rows.select(*by, tick.alias("tick"), at.alias("at"), *[have.get(n, zero(n)).alias(f"_a{n}") for n in range(len(aggs))])

    def running(parts: list[DataFrame], points: DataFrame, order: str, run: list[str]) -> DataFrame:
        """The sums of ``parts`` up to each of ``points``."""
        every = points.withColumn("_point", F.lit(True))
        for x in parts:
            every = every.unionByName(x.withColumn("_point", F.lit(False)), allowMissingColumns=True)
        w = Window.partitionBy(*run).orderBy(order)
        return every.withColumns({f"_a{n}": F.sum(f"_a{n}").over(w) for n in range(len(aggs))}).filter("_point").drop("_point")

    plain = {}
    for n, a in enumerate(aggs):
        v = F.col(f"_v{n}")
        if not a.is_distinct:
            plain[n] = F.count(v) if a.fn == "count" else F.coalesce(F.sum(v), F.lit(0.0))
    sums = r.groupBy(*by, "pane", "tick").agg(F.count(F.lit(1)).alias("_n"), *[c.alias(f"_a{n}") for n, c in plain.items()])
    have = {n: F.col(f"_a{n}") for n in plain}
    # ``at`` is what the parts are summed along: the tick for first emissions, the window's end for later ones.
    first = [part(sums, F.col("tick"), F.col("tick"), have)]
    more = [part(sums.filter(late), F.col("tick"), F.col("pane") + slide, have)]
    for n, a in enumerate(aggs):
        if a.is_distinct:
            v = r.filter(F.col(f"_v{n}").isNotNull()).groupBy(*by, f"_v{n}", "pane").agg(F.min("tick").alias("tick"))
            first.append(part(v.groupBy(*by, f"_v{n}").agg(F.min("tick").alias("tick")), F.col("tick"), F.col("tick"), {n: F.lit(1).cast("long")}))
            w = Window.partitionBy(*by, f"_v{n}").orderBy("pane")
            begin = F.col("pane") + slide
            stay = v.select(*by, F.min("tick").over(w).alias("tick"), begin.alias("a"), F.coalesce(F.lead("pane").over(w) + slide, F.col("day") + DAY_MS + slide).alias("b"))
            stay = stay.withColumn("b", F.least("b", "tick")).filter("a < b")
            both = F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).cast("long").alias("c")), F.struct(F.col("b").alias("at"), F.lit(-1).cast("long").alias("c"))))
            more.append(part(stay.select(*by, "tick", both.alias("x")), F.col("tick"), F.col("x.at"), {n: F.col("x.c")}))
    zeros = {f"_a{n}": zero(n) for n in range(len(aggs))}
    base = running(first, emitted.select(*by, F.col("end").alias("tick"), F.col("end").alias("at")).distinct().withColumns(zeros), "at", by)
    revised = running(more, emitted.filter("tick > end").select(*by, "tick", F.col("end").alias("at")).withColumns(zeros), "at", [*by, "tick"])
    # First emissions that are due stand as the first of the running sum, whether or not the window was given then.
    steps = base.withColumn("tick", F.col("at")).unionByName(revised)
    w = Window.partitionBy(*by, "at").orderBy("tick")
    steps = steps.withColumns({f"_a{n}": F.sum(f"_a{n}").over(w) for n in range(len(aggs))})
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"s.{k}")) for k in by] + [F.col("e.end") == F.col("s.at"), F.col("e.tick") == F.col("s.tick")]
    out = emitted.alias("e").join(steps.alias("s"), on)
    return out.select(*[F.col(f"e.{k}").alias(k) for k in keys], F.col("e.end").alias("end"), F.col("e.tick").alias("tick"), *[F.col(f"s._a{n}").alias(f"_a{n}") for n in range(len(aggs))])


def latest(revised: DataFrame, keys: list[str]) -> DataFrame:
    """The greatest tick of each (key, end): what an upserting sink holds in the end."""
    w = Window.partitionBy(*keys, "end").orderBy(F.desc("tick"))
    return revised.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
