"""Sliding and day-cumulative windows from panes.

A row adds to one pane. Windows are made from panes without copying a row into each window that holds
it: sums from prefix and suffix sums of blocks of panes, two additions a window and none of them a
subtraction; counts and distinct counts from the change at the first and last window that a pane or a value is alive
in. Panes are pre-aggregated before any shuffle, so a hot key costs as many rows as it has panes.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewheel.functions.timeutil import DAY_MS, day_start, floor_to, format_text, parse_ms
from tidewheel.plans.config import Aggregate, WindowConfig


def _keys(cfg: WindowConfig) -> list[str]:
    return [f"_k{i}" for i in range(len(cfg.key_fields))]


def _value(df: DataFrame, a: Aggregate) -> Column:
    c = F.col(f"`{df.columns[a.index]}`")
    kind = {"sum": "double", "distinct_int": "int", "distinct_long": "long", "count": None}.get(a.fn, "string")
    return c.cast(kind) if kind else c


def rows(df: DataFrame, cfg: WindowConfig, extra: list[str] | None = None) -> DataFrame:
    """Key columns, t, pane and a column for each aggregate; rows without a time go."""
    name = df.columns[cfg.time_field]
    keys = [F.col(f"`{df.columns[i]}`").alias(f"_k{n}") for n, i in enumerate(cfg.key_fields)]
    values = [_value(df, a).alias(f"_v{n}") for n, a in enumerate(cfg.group.aggregates)]
    t = parse_ms(F.col(f"`{name}`"), df.schema[name].dataType, cfg.strict)
    out = df.select(*keys, t.alias("t"), *values, *(extra or [])).filter("t is not null")
    return out.withColumn("pane", floor_to(F.col("t"), cfg.slide))


def _day(end: Column, cfg: WindowConfig) -> Column:
    """The day of the window that ends at ``end``: midnight still belongs to the day before."""
    return day_start(end - 1, cfg.zone_ms)


def panes(r: DataFrame, cfg: WindowConfig, sign: str | None = None) -> DataFrame:
    """(keys, pane) with a partial for each count and sum; ``sign`` is 1, or -1 for retracted rows."""
    s = F.col(sign) if sign else F.lit(1)
    parts = []
    for n, a in enumerate(cfg.group.aggregates):
        v = F.col(f"_v{n}")
        if a.fn == "count":
            parts.append(F.sum(F.when(v.isNotNull(), s).otherwise(0)).cast("long").alias(f"_a{n}"))
        elif a.fn == "sum":
            parts.append(F.coalesce(F.sum(v * s), F.lit(0.0)).alias(f"_a{n}"))
    return r.groupBy(*_keys(cfg), "pane").agg(F.max(s).alias("_live"), F.min("t").alias("_from"), *parts)


def _distinct_changes(r: DataFrame, n: int, cfg: WindowConfig, sign: str | None) -> DataFrame:
    """(keys, end, change), several rows an end: where a value's stay in the windows begins and ends."""
    keys, v = _keys(cfg), f"_v{n}"
    each = r.filter(F.col(v).isNotNull()).groupBy(*keys, "pane", v).agg(F.sum(F.col(sign) if sign else F.lit(1)).alias("refs"))
    each = each.filter("refs > 0")
    by = [*keys, v]
    if cfg.start_zero:
        each = each.withColumn("_d", day_start(F.col("pane"), cfg.zone_ms))
        by = [*by, "_d"]
    each = each.withColumn("_next", F.lead("pane").over(Window.partitionBy(*by).orderBy("pane")))
    gone = F.least(F.col("pane") + cfg.reach, F.coalesce("_next", F.lit(1 << 62))) + cfg.slide
    both = F.array(F.struct((F.col("pane") + cfg.slide).alias("end"), F.lit(1).cast("long").alias("c")), F.struct(gone.alias("end"), F.lit(-1).cast("long").alias("c")))
    moved = each.select(*keys, F.col("pane"), F.explode(both).alias("x")).select(*keys, "pane", "x.*")
    if cfg.start_zero:  # a value that is alive at midnight is not carried over
        moved = moved.filter(_day(F.col("end"), cfg) == day_start(F.col("pane"), cfg.zone_ms))
    return moved.select(*keys, "end", F.col("c").alias(f"_a{n}"))


def _points(r: DataFrame, cfg: WindowConfig, sign: str | None) -> DataFrame:
    """(keys, end) and, in day mode, the day _d: the ends at which a window differs from the one before it.

    ``_a`` is a count's or distinct count's change, ``_e`` and ``_l`` what a sum's panes bring at the first end that
    holds them and at the first that doesn't. ``_pane`` and ``_from`` are those of a pane of live rows that enters;
    ``_mark`` tells that one enters or leaves. At a day's first end stands a row if panes of the day before are still inside.
    """
    keys, aggs = _keys(cfg), cfg.group.aggregates
    if cfg.start_zero:  # a pane across midnight belongs to no day
        inside = r.filter(day_start(F.col("pane"), cfg.zone_ms) == day_start(F.col("pane") + cfg.slide - 1, cfg.zone_ms))
    else:
        inside = r
    counts, sums = [n for n, a in enumerate(aggs) if a.fn == "count"], [n for n, a in enumerate(aggs) if a.fn == "sum"]
    steps = [n for n, a in enumerate(aggs) if a.fn != "sum"]
    zeros = {f"_a{n}": F.lit(0).cast("long") for n in steps} | {f"_{x}{n}": F.lit(0.0) for n in sums for x in "el"}
    none = {"_pane": F.lit(None).cast("long"), "_from": F.lit(None).cast("long"), "_mark": F.lit(False)}
    enters, leaves = F.col("pane") + cfg.slide, F.col("pane") + cfg.reach + cfg.slide

    def point(end: Column, day: Column | None = None, **own: Column) -> Column:
        day = [(_day(end, cfg) if day is None else day).alias("_d")] if cfg.start_zero else []
        return F.struct(end.alias("end"), *day, *[c.alias(k) for k, c in (zeros | none | own).items()])

    def spread(df: DataFrame, points: list[Column]) -> DataFrame:
        return df.select(*keys, F.explode(F.array_compact(F.array(*points))).alias("x")).select(*keys, "x.*")

    own = None if sign or cfg.start_zero else {"_pane": F.col("pane"), "_from": F.col("_from"), "_mark": F.lit(True)}
    day = day_start(F.col("pane"), cfg.zone_ms) if cfg.start_zero else None
    into = {f"_a{n}": F.col(f"_a{n}") for n in counts} | {f"_e{n}": F.col(f"_a{n}") for n in sums}
    out_of = {f"_a{n}": -F.col(f"_a{n}") for n in counts} | {f"_l{n}": F.col(f"_a{n}") for n in sums}
    both = [point(enters, day, **into, **(own or {})), point(leaves, day, **out_of, **({"_mark": F.lit(True)} if own else {}))]
    if cfg.start_zero:
        both.append(F.when(_day(leaves, cfg) != day, point(floor_to(day + DAY_MS, cfg.slide) + cfg.slide)))
    every = spread(panes(inside, cfg, sign), both)
    if own is None:
        alive = (r.filter(F.col(sign) > 0) if sign else r).groupBy(*keys, "pane").agg(F.min("t").alias("_from"))
        ends = [point(enters, _pane=F.col("pane"), _from=F.col("_from"), _mark=F.lit(True))]
        every = every.unionByName(spread(alive, ends if cfg.always else [*ends, point(leaves, _mark=F.lit(True))]))
    for n in steps:
        if aggs[n].is_distinct:
            moved = _distinct_changes(inside, n, cfg, sign)
            every = every.unionByName(moved.select(*keys, point(F.col("end"), **{f"_a{n}": F.col(f"_a{n}")}).alias("x")).select(*keys, "x.*"))
    by = [*keys, "end", "_d"] if cfg.start_zero else [*keys, "end"]
    return every.groupBy(*by).agg(*[F.sum(c).alias(c) for c in zeros], F.max("_pane").alias("_pane"), F.min("_from").alias("_from"), F.max("_mark").alias("_mark"))


def compute(r: DataFrame, cfg: WindowConfig, sign: str | None = None) -> DataFrame:
    """(keys, end) with a value for each aggregate, for all windows that are due, without gaps inside an island.

    A window differs from the one before it only where a pane enters or leaves, so all shuffles and sorts are of
    such ends; the windows between two of them are made last. A key's clock stops after ``split + 1`` empty ticks and
    starts anew with its next row, which begins another island. With ``keep_old`` it runs to the last pane of all keys.
    """
    keys, aggs, slide = _keys(cfg), cfg.group.aggregates, cfg.slide
    at = _points(r, cfg, sign)
    run = [*keys, "_d"] if cfg.start_zero else keys
    sums = [n for n, a in enumerate(aggs) if a.fn == "sum"]
    if sums:
        # Blocks of ``split`` panes: a window holds what has entered in its own block, and of the block before
        # what leaves later in its own.
        at = at.withColumn("_block", F.floor(F.col("end") / slide / cfg.split))
        block = Window.partitionBy(*run, "_block")
        back = block.orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
        at = at.withColumns({f"_l{n}": F.coalesce(F.sum(f"_l{n}").over(back), F.lit(0.0)) for n in sums})
        at = at.withColumns({f"_e{n}": F.sum(f"_e{n}").over(block.orderBy("end")) for n in sums})
    order = Window.partitionBy(*keys).orderBy("end")
    values = {f"_a{n}": F.sum(f"_a{n}").over(Window.partitionBy(*run).orderBy("end")) for n in range(len(aggs)) if n not in sums}
    at = at.withColumns(values | {f"_a{n}": F.col(f"_e{n}") + F.col(f"_l{n}") for n in sums})
    if cfg.start_zero:
        at = at.filter(_day(F.col("end"), cfg) == F.col("_d"))
    before = F.max("_pane").over(order.rowsBetween(Window.unboundedPreceding, -1))
    idle = F.lit(False) if cfg.keep_old else F.col("_from") - before >= (cfg.split + 2) * slide + cfg.lateness
    at = at.withColumn("_new", F.col("_pane").isNotNull() & (before.isNull() | idle))
    due = F.last(F.when(F.col("_new"), floor_to(F.col("_from") + cfg.trigger_late, slide) + slide), ignorenulls=True).over(order)
    at = at.withColumns({"_due": due, "_next": F.lead("end").over(order), "_over": F.lead("_new").over(order), "_last": F.max("_pane").over(order)})
    if cfg.keep_old:
        last = (r.filter(F.col(sign) > 0) if sign else r).agg(F.max("pane").alias("_until"))
        at = at.crossJoin(F.broadcast(last.select((F.col("_until") + slide).alias("_until"))))
        stop = F.least(F.coalesce(F.col("_next") - slide, F.col("_until")), "_until")
    else:
        until = F.col("_last") + (cfg.split + 2) * slide
        stop = F.when(F.col("_next").isNull() | F.col("_over"), until).otherwise(F.col("_next") - slide)
    start = F.greatest("end", "_due")
    if not cfg.always:  # only the ticks at which a pane enters or leaves
        return at.filter(F.col("_mark") & (start == F.col("end")) & (stop >= start)).select(*keys, "end", *[f"_a{n}" for n in range(len(aggs))])
    ends = F.when(stop >= start, F.sequence(start, stop, F.lit(slide)))
    return at.select(*keys, *[f"_a{n}" for n in range(len(aggs))], F.explode(ends).alias("end")).select(*keys, "end", *[f"_a{n}" for n in range(len(aggs))])


def output(done: DataFrame, cfg: WindowConfig) -> DataFrame:
    """The fields and aggregates of the specification, by position."""
    end, start = F.col("end"), F.col("end") - cfg.size
    seconds = lambda c: F.floor(c / 1000).cast("long")
    key_text = F.concat_ws(",", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in _keys(cfg)])
    known = {
        "key": key_text,
        "starttime": format_text(seconds(start)),
        "starttime_10": seconds(start),
        "starttime_13": start,
        "endtime": format_text(seconds(end) - 1),
        "endtime_10": seconds(end) - 1,
        "endtime_13": end - 1,
    }
    fields = [(known[f] if f in known else F.col(f"_k{int(f.split('_')[1])}")).alias(f) for f in cfg.group.fields]
    return done.select(*fields, *[F.col(f"_a{n}").alias(a.spec) for n, a in enumerate(cfg.group.aggregates)])


def windowed(df: DataFrame, cfg: WindowConfig) -> DataFrame:
    """All windows of an append-only table, late rows in their place."""
    return output(compute(rows(df, cfg), cfg), cfg)


def legacy_windowed(df: DataFrame, cfg: WindowConfig) -> DataFrame:
    """The older form of the operator: every tick from a key's second on, and null is one more distinct text."""
    r = rows(df, cfg)
    for n, a in enumerate(cfg.group.aggregates):
        if a.fn == "distinct":
            r = r.withColumn(f"_v{n}", F.coalesce(F.concat(F.lit("="), f"_v{n}"), F.lit("null")))
    cfg = replace(cfg, trigger_late=cfg.trigger_late + cfg.slide, always=True)
    return output(compute(r, cfg), cfg)


def bitmap_distinct(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Exact distinct counts of whole numbers by mergeable bitmaps, one for each bucket of values."""
    v = F.col(value).cast("long")
    parts = df.filter(v.isNotNull()).groupBy(*keys, F.bitmap_bucket_number(v).alias("_b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(v)).alias("_m"))
    return parts.groupBy(*keys).agg(F.sum(F.bitmap_count("_m")).alias("n_distinct"))
