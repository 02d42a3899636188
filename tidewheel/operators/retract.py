"""Retraction: rows named in a detail table are subtracted from the windows that hold them.

Counts and sums get a signed row; a distinct value goes when its last occurrence is taken back. A detail
is found by the row's primary key and subtracted at the time in its text; if the key has no pane there, or
no row had that primary key, nothing happens. A primary key counts once in the details, however often it
was added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewheel.functions.timeutil import floor_to, parse_ms
from tidewheel.operators import detail
from tidewheel.operators import windows as W
from tidewheel.plans.config import WindowConfig


def signed(df: DataFrame, details: DataFrame, cfg: WindowConfig) -> DataFrame:
    """The rows with sign 1 and the retractions of their details with sign -1."""
    spec = cfg.retraction
    if spec is None:
        raise ValueError("no retraction is configured")
    pk = F.col(f"`{df.columns[spec.field]}`").cast("string").alias("_pk")
    hkey = detail.hash_key(df, spec.prefix, spec.suffix).alias("_hkey")
    keys = [f"_k{i}" for i in range(len(cfg.key_fields))]
    r = W.rows(df, cfg, [pk, hkey])
    plus = r.drop("_pk", "_hkey").withColumn("_sign", F.lit(1))
    owner = r.filter("_pk is not null").select(*keys, "_pk", "_hkey").distinct()
    d = details.select(F.col("hkey").alias("_hkey"), F.col("field").alias("_pk"), F.split("value", r"\Q" + spec.split + r"\E", -1).alias("_parts"))
    met = owner.join(d, ["_hkey", "_pk"])
    t = parse_ms(F.get("_parts", F.lit(spec.value_time)), T.StringType())
    where = dict(spec.value_map)
    values = []
    for n, a in enumerate(cfg.group.aggregates):
        kind = {"sum": "double", "distinct_int": "int", "distinct_long": "long"}.get(a.fn, "string")
        text = F.get("_parts", F.lit(where[n])) if n in where else F.lit(None).cast("string")
        known = F.when(text != "null", text)
        values.append((known if a.fn == "count" else known.try_cast(kind)).alias(f"_v{n}"))
    minus = met.select(*keys, t.alias("t"), *values).filter("t is not null").withColumn("pane", floor_to(F.col("t"), cfg.slide))
    panes = plus.select(*keys, "pane").distinct()
    on = [F.col(f"m.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys] + [F.col("m.pane") == F.col("p.pane")]
    minus = minus.alias("m").join(panes.alias("p"), on, "left_semi").withColumn("_sign", F.lit(-1))
    for n, a in enumerate(cfg.group.aggregates):  # counts only ask whether there is a value
        if a.fn == "count":
            plus = plus.withColumn(f"_v{n}", F.col(f"_v{n}").cast("string"))
    return plus.unionByName(minus.select(*plus.columns))


def retracted(df: DataFrame, details: DataFrame, cfg: WindowConfig) -> DataFrame:
    """The windows after the details are taken back."""
    return W.output(W.compute(signed(df, details, cfg), cfg, "_sign"), cfg)
