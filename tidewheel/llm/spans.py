"""Regex matches with code-point offsets from Spark SQL functions alone.

``split`` with limit -1 gives the text between matches and ``regexp_extract_all`` the matches; running
sums of their lengths are the offsets. Lengths of Spark strings count code points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.llm.storage import let

SPAN = "array<struct<start:int,end:int,hit:string,before:string,after:string>>"


def none() -> Column:
    return F.array().cast(SPAN)


def matches(text: Column, pattern: str, where: Column | None = None, context: int = 48) -> Column:
    """All leftmost non-overlapping matches as (start, end, hit, before, after), end exclusive.

    ``before`` and ``after`` are up to ``context`` code points on each side of the match, cut at the neighbouring matches.
    ``where`` is a cheap necessary condition; without it holding no regex runs.
    """

    def add(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        around = (F.right(x["gap"], F.lit(context)).alias("before"), F.left(F.coalesce(x["next"], F.lit("")), F.lit(context)).alias("after"))
        span = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), *around)
        return F.when(x["hit"].isNull(), state).otherwise(F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out")))

    def of(gaps: Column) -> Column:
        hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        found = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"), F.slice(gaps, F.lit(2), F.size(gaps)).alias("next"))
        return F.aggregate(found, F.struct(F.lit(0).alias("at"), none().alias("out")), add, lambda s: s["out"])

    out = let(F.split(text, pattern, -1), of)
    return out if where is None else F.when(where, out).otherwise(none())


def written(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end, comma-joined, in the order of the array."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits in ``value`` pass the Luhn check."""

    def total(d: Column) -> Column:
        at = F.sequence(F.lit(1), F.length(d))

        def add(acc: Column, i: Column) -> Column:
            n = F.substring(d, F.length(d) - i + 1, F.lit(1)).cast("int")
            twice = n * 2
            return acc + F.when(i % 2 == 1, n).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

        return F.when(F.length(d) > 0, F.aggregate(at, F.lit(0), add)).otherwise(F.lit(1)) % 10 == 0

    return let(digits(value), total)
