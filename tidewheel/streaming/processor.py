"""Windows over a stream: panes and clocks in checkpointed state, ticks driven by timers.

A key's clock is the arrival time of its rows and, between them, the stream's watermark (or the wall clock in
processing-time mode): timers give the windows that are due though no row of the key comes. Rows are folded
in order of arrival, and what is due before a row is given before the row is folded, so results don't depend
on how the stream is cut into batches.

A late or retracted row marks the windows of its day that were given without it; they are given again at the
next tick, after the tick's own window is due, in order. Panes that no window can ask for any more are
deleted; a key is forgotten ``split + 2`` ticks after its last pane.

Rows are packed ahead of the shuffle: those of a task that have key, tick, pane and sign in common are one row, with
their count, their sum and each distinct value's number of occurrences. State is an entry for each pane, of the same; a
call reads a key's state once, moves a running window over it and writes back the panes that changed. In a call
values are numbered, and sets of them are arrays of numbers.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewheel.functions.timeutil import DAY_MS
from tidewheel.operators import windows as W
from tidewheel.plans.config import WindowConfig

#: Rows of a task that are packed at once.
PACK_ROWS = 1 << 20
_NONE = (np.empty(0, np.int64), np.empty(0, np.int64))


class _Panes:
    """A key's state in memory; remembers which panes changed."""

    def __init__(self, panes: Any, clock: Any, again: Any, distinct: list[int], packs: pd.DataFrame | None = None):
        #: The next tick, the first one, the last pane and the arrival of the last row; None for an unknown key.
        self.clock: tuple[int, int, int, int] | None = tuple(clock.get()) if clock.exists() else None
        #: The windows that are to be given again.
        self.again: set[int] = {w for (w,), _ in again.iterator()}
        self.totals: dict[int, dict[int, list]] = {}
        #: Of each pane and aggregate the numbers of its values and how often each occurs, more than 0 times.
        self.values: dict[int, dict[int, tuple[np.ndarray, np.ndarray]]] = {}
        self.changed: set[int] = set()
        held: dict[int, dict[int, tuple]] = {}
        for (pane,), (data,) in panes.iterator():
            self.totals[pane], held[pane] = pickle.loads(bytes(data))
        #: The values of each aggregate by number, and those of each of ``packs``.
        self.names: dict[int, np.ndarray] = {}
        self.packed: dict[int, list[np.ndarray]] = {}
        for n in distinct:
            own = [(pane, *of[n]) for pane, of in held.items() if n in of]
            parts = [np.asarray(names) for _, names, _ in own] + ([np.asarray(x) for x in packs[f"v{n}"]] if packs is not None else [])
            full = [x for x in parts if len(x)]
            codes, self.names[n] = pd.factorize(np.concatenate(full)) if full else (_NONE[0], _NONE[0])
            codes = np.split(codes.astype(np.int64), np.cumsum([len(x) for x in parts])[:-1]) if parts else []
            for (pane, _, times), c in zip(own, codes, strict=False):
                self.values.setdefault(pane, {})[n] = (c, times)
            self.packed[n] = codes[len(own) :]

    def add(self, pane: int, n: int, count: int, total: float) -> None:
        at = self.totals.setdefault(pane, {}).setdefault(n, [0, 0.0])
        at[0], at[1] = at[0] + count, at[1] + total
        self.changed.add(pane)

    def refer(self, pane: int, n: int, codes: np.ndarray, times: np.ndarray) -> None:
        """Take back what has negative ``times``, then add the rest; a value that was never added can't be taken back."""
        had, often = self.values.get(pane, {}).get(n, _NONE)
        every, at = np.unique(np.concatenate([had, codes]), return_inverse=True)
        count = lambda where, what: np.bincount(at[where], what, len(every)).astype(np.int64)
        new = slice(len(had), None)
        now = np.maximum(0, count(slice(len(had)), often) - count(new, np.maximum(0, -times))) + count(new, np.maximum(0, times))
        self.values.setdefault(pane, {})[n] = (every[now > 0], now[now > 0])
        self.changed.add(pane)

    def of(self, pane: int, n: int) -> np.ndarray:
        return self.values.get(pane, {}).get(n, _NONE)[0]

    def forget(self, pane: int) -> None:
        self.values.pop(pane, None)
        self.totals.pop(pane, None)
        self.changed.add(pane)

    def save(self, panes: Any, clock: Any, again: Any) -> None:
        if self.clock is not None:
            clock.update(self.clock)
        elif clock.exists():
            clock.clear()
        again.clear()
        for w in self.again:
            again.updateValue((w,), (True,))
        for pane in self.changed:
            if pane in self.totals:
                values = {n: (self.names[n][codes], times) for n, (codes, times) in self.values.get(pane, {}).items()}
                panes.updateValue((pane,), (pickle.dumps((self.totals[pane], values), 5),))
            elif panes.containsKey((pane,)):
                panes.removeKey((pane,))


class WindowProcessor(StatefulProcessor):
    def __init__(self, cfg: WindowConfig, n_keys: int, processing: bool, idle_ms: int | None):
        self.cfg, self.n_keys, self.processing, self.idle_ms = cfg, n_keys, processing, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        ttl = {"ttlDurationMs": self.idle_ms} if self.idle_ms and self.processing else {}
        self.handle = handle
        self.panes = handle.getMapState("panes", "pane long", "data binary", **ttl)
        self.clock = handle.getValueState("clock", "due long, first long, last long, seen long", **ttl)
        self.again = handle.getMapState("again", "window long", "marked boolean", **ttl)

    def _day(self, ms: int) -> int:
        return ms - (ms + self.cfg.zone_ms) % DAY_MS

    def _first(self, end: int) -> int:
        """The first pane of the window that ends at ``end``."""
        first = end - self.cfg.reach
        return max(first, self._day(end - 1)) if self.cfg.start_zero else first

    def _whole(self, pane: int) -> bool:
        """Whether a pane is of one day; one across midnight belongs to no day."""
        return not self.cfg.start_zero or self._day(pane) == self._day(pane + self.cfg.slide - 1)

    def _inside(self, held: _Panes, end: int) -> list[int]:
        slide, first = self.cfg.slide, self._first(end)
        low = -(-first // slide) * slide
        if (end - low) // slide <= 4 * len(held.totals):
            return [p for p in range(low, end, slide) if p in held.totals and self._whole(p)]
        return sorted(p for p in held.totals if low <= p < end and self._whole(p))

    def _value(self, held: _Panes, end: int, running: dict | None) -> list[Any]:
        """The aggregates of a window; ``running`` holds the distinct values of the one before it."""
        inside = self._inside(held, end)
        out: list[Any] = []
        for n, a in enumerate(self.cfg.group.aggregates):
            if a.is_distinct:
                if running is not None:
                    out.append(self._advance(held, inside, running, n))
                else:
                    seen = np.zeros(len(held.names[n]), bool)
                    for p in inside:
                        seen[held.of(p, n)] = True
                    out.append(int(np.count_nonzero(seen)))
            elif a.fn == "count":
                out.append(sum(held.totals[p].get(n, (0, 0))[0] for p in inside))
            else:
                parts = [held.totals[p].get(n, (0, 0.0))[1] for p in inside]
                out.append(math.fsum(parts) if all(map(math.isfinite, parts)) else float(sum(parts)))
        return out

    def _advance(self, held: _Panes, inside: list[int], running: dict, n: int) -> int:
        """How many values the window has: how many of its panes hold each, from the last window's by the panes that came and went."""
        before, live, size = running[n] if n in running else (frozenset(), np.zeros(len(held.names[n]), np.int32), 0)
        now = frozenset(inside)
        for p in before - now:
            codes = held.of(p, n)
            live[codes] -= 1
            size -= int(np.count_nonzero(live[codes] == 0))
        for p in now - before:
            codes = held.of(p, n)
            size += int(np.count_nonzero(live[codes] == 0))
            live[codes] += 1
        running[n] = (now, live, size)
        return size

    def _fire(self, key: tuple, held: _Panes, running: dict, until: int) -> Iterator[tuple]:
        """Give all windows that are due at ``until``."""
        cfg = self.cfg
        keep = cfg.reach + (max(cfg.reach, DAY_MS) if cfg.recount else 0)
        while held.clock is not None:
            due, first, last, seen = held.clock
            if due + cfg.lateness > until:
                return
            marked = sorted(held.again)
            for w in marked:
                if w < due:
                    yield (*key, w, *self._value(held, w, None), due)
            held.again.clear()
            if cfg.always or due in marked or due - cfg.slide in held.totals or due - cfg.reach - cfg.slide in held.totals:
                yield (*key, due, *self._value(held, due, running), due)
            for p in [p for p in held.totals if p < due - keep]:
                if any(p in inside for inside, *_ in running.values()):
                    running.clear()
                held.forget(p)
            idle = self.idle_ms is not None and due - seen > self.idle_ms
            if idle or not cfg.keep_old and due >= last + (cfg.split + 2) * cfg.slide:
                for p in list(held.totals) + list(held.values):
                    held.forget(p)
                running.clear()
                held.clock = None
                return
            held.clock = (due + cfg.slide, first, last, seen)

    def _fold(self, held: _Panes, running: dict, rows: pd.DataFrame, tick: int) -> None:
        """Add packs whose next tick is ``tick``."""
        cfg = self.cfg
        plus = rows[rows["sign"] > 0]
        if held.clock is None:
            if plus.empty:
                return  # nothing to take back
            start = int(plus["low"].min()) + cfg.trigger_late
            due = start - start % cfg.slide + cfg.slide
            held.clock = (due, due, int(plus["pane"].max()), int(rows["high"].max()))
        due, first, last, seen = held.clock
        rows = rows[~rows["late"].astype(bool)]
        for pane, own in rows.groupby("pane", sort=True):
            pane = int(pane)
            added = own["sign"].to_numpy() > 0
            if not added.any() and pane not in held.totals:
                continue  # what is taken back was never added
            if due > pane + cfg.slide:  # its own window was given without it, or is about to be
                running.clear()
                if cfg.recount or not added.all():
                    stop = min(self._day(pane) + DAY_MS, due)
                    held.again.update(range(max(pane + cfg.slide, first), stop + 1, cfg.slide))
            held.totals.setdefault(pane, {})
            held.add(pane, -1, 0, 0.0)
            for n, a in enumerate(cfg.group.aggregates):
                if a.is_distinct:
                    codes = np.concatenate([held.packed[n][i] for i in own["at"]])
                    times = np.concatenate([np.asarray(t, np.int64) * s for t, s in zip(own[f"n{n}"], own["sign"], strict=True)])
                    held.refer(pane, n, codes, times)
                elif a.fn == "count":
                    held.add(pane, n, int(own[f"v{n}"].sum()), 0.0)
                else:
                    held.add(pane, n, 0, float(own[f"v{n}"].sum(skipna=False)))
            if added.any():
                last = max(last, pane)
        if len(rows):
            held.clock = (due, first, last, max(seen, int(rows["high"].max())))

    def _load(self, packs: pd.DataFrame | None = None) -> _Panes:
        return _Panes(self.panes, self.clock, self.again, [n for n, a in enumerate(self.cfg.group.aggregates) if a.is_distinct], packs)

    def _save(self, held: _Panes) -> None:
        """Write the state back and set one timer, at the next tick."""
        held.save(self.panes, self.clock, self.again)
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held.clock is not None:
            self.handle.registerTimer(int(held.clock[0] + self.cfg.lateness))

    def _frame(self, out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=[*[f"_k{i}" for i in range(self.n_keys)], "end", *[f"_a{n}" for n in range(len(self.cfg.group.aggregates))], "tick"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        if self.processing:
            now = timerValues.getCurrentProcessingTimeInMs()
            batch["low"] = batch["high"] = now
            batch["tick"] = tick = int(_ticks(self.cfg, now))
            batch["late"] = _late(self.cfg, batch["sign"].to_numpy(), batch["t"].to_numpy(), tick)
        batch["at"] = np.arange(len(batch))
        held, running, out = self._load(batch), {}, []
        for tick, own in batch.groupby("tick", sort=True):
            out += self._fire(key, held, running, int(own["low"].min()))
            self._fold(held, running, own, int(tick))
        self._save(held)
        yield self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs() if self.processing else timerValues.getCurrentWatermarkInMs()
        held = self._load()
        out = list(self._fire(key, held, {}, int(now)))
        self._save(held)
        yield self._frame(out)

    def close(self) -> None:
        pass


def _ticks(cfg: WindowConfig, clock: Any) -> Any:
    """The next tick of rows that come in at ``clock``."""
    after = clock - cfg.lateness
    return after - after % cfg.slide + cfg.slide


def _late(cfg: WindowConfig, sign: np.ndarray, t: np.ndarray, tick: Any) -> np.ndarray:
    """Which rows come too late for their day."""
    if not cfg.start_zero:
        return np.zeros(len(t), bool)
    day = lambda ms: ms - (ms + cfg.zone_ms) % DAY_MS
    return (sign > 0) & (tick - t > cfg.late_limit) & (day(tick) > day(t))


def _packs(cfg: WindowConfig, n_keys: int, processing: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``stream_rows`` gives as packs: rows of a key, tick, pane and sign, or with the wall clock of a time, are one.

    ``low`` and ``high`` are the first and last of their arrivals; ``n`` is how often each distinct value of ``v`` occurs.
    """

    def pack(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        column = lambda name: _flat(table.column(name))
        ints = {c: table.column(c).to_numpy() for c in ("t", "pane", "clock", "sign")}
        tick = _ticks(cfg, ints["clock"])
        late = np.zeros(len(table), bool) if processing else _late(cfg, ints["sign"], ints["t"], tick)
        keys = {f"_k{i}": column(f"_k{i}").dictionary_encode("encode").indices.to_numpy() for i in range(n_keys)}
        by = pd.DataFrame(keys | {"at": ints["t"] if processing else tick, "pane": ints["pane"], "sign": ints["sign"], "late": late})
        of = by.groupby(list(by.columns), sort=False).ngroup().to_numpy()
        order = np.argsort(of, kind="stable")
        first = np.flatnonzero(np.diff(of[order], prepend=-1))
        head = order[first]
        out = [column(f"_k{i}").take(pa.array(head)) for i in range(n_keys)]
        out += [pa.array(x) for x in (tick[head], ints["t"][head], ints["pane"][head], ints["sign"][head].astype(np.int32), late[head])]
        clock = ints["clock"][order]
        out += [pa.array(np.minimum.reduceat(clock, first)), pa.array(np.maximum.reduceat(clock, first))]
        for n, a in enumerate(cfg.group.aggregates):
            v = column(f"v{n}")
            if not a.is_distinct:
                out.append(pa.array(np.add.reduceat(v.to_numpy(zero_copy_only=False)[order], first)))
                continue
            known = np.flatnonzero(v.is_valid().to_numpy(zero_copy_only=False))
            named = v.take(pa.array(known)).dictionary_encode()
            size = max(1, len(named.dictionary))
            each, times = np.unique(of[known] * size + named.indices.to_numpy(), return_counts=True)
            ends = pa.array(np.searchsorted(each // size, np.arange(len(head) + 1)).astype(np.int32))
            out.append(pa.ListArray.from_arrays(ends, named.dictionary.take(pa.array(each % size))))
            out.append(pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32))))
        return pa.RecordBatch.from_arrays(out, names=_pack_names(cfg, n_keys))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += len(batch)
            if rows >= PACK_ROWS:
                yield pack(held)
                held, rows = [], 0
        if rows:
            yield pack(held)

    return work


def _flat(c: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(c.chunks)


def _pack_names(cfg: WindowConfig, n_keys: int) -> list[str]:
    values = [x for n, a in enumerate(cfg.group.aggregates) for x in ([f"v{n}", f"n{n}"] if a.is_distinct else [f"v{n}"])]
    return [*[f"_k{i}" for i in range(n_keys)], "tick", "t", "pane", "sign", "late", "low", "high", *values]


def _pack_kinds(cfg: WindowConfig) -> list[str]:
    values = []
    for n, a in enumerate(cfg.group.aggregates):
        if a.is_distinct:
            values += [f"v{n} array<{_kind(a.fn)}>", f"n{n} array<int>"]
        else:
            values.append(f"v{n} {'double' if a.fn == 'sum' else 'long'}")
    return ["tick long", "t long", "pane long", "sign int", "late boolean", "low long", "high long", *values]


def _kind(fn: str) -> str:
    return "long" if fn in ("distinct_int", "distinct_long") else "string"


def stream_rows(df: DataFrame, cfg: WindowConfig, clock: str | None = None, sign: str | None = None) -> DataFrame:
    """Keys, t, pane, clock, sign and a value for each aggregate, of which packs are made for the processor.

    ``clock`` names a column of epoch milliseconds at which a row came in; without it, its own time is taken.
    ``sign`` is 1, or -1 for a row that takes back what an earlier one added.
    """
    extra = [F.col(clock).alias("_clock")] if clock else []
    extra += [F.col(sign).alias("_sign")] if sign else []
    r = W.rows(df, cfg, extra)
    s = F.col("_sign") if sign else F.lit(1)
    values = []
    for n, a in enumerate(cfg.group.aggregates):
        v = F.col(f"_v{n}")
        if a.fn == "count":
            values.append(F.when(v.isNotNull(), s).otherwise(0).cast("long").alias(f"v{n}"))
        elif a.fn == "sum":
            values.append(F.coalesce(v * s, F.lit(0.0)).alias(f"v{n}"))
        else:
            values.append(v.cast(_kind(a.fn)).alias(f"v{n}"))
    keys = [f"_k{i}" for i in range(len(cfg.key_fields))]
    at = F.coalesce(F.col("_clock").cast("long") if clock else F.col("t"), F.col("t"))
    return r.select(*keys, "t", "pane", at.alias("clock"), s.cast("int").alias("sign"), *values)


def revised_stream(df: DataFrame, cfg: WindowConfig, clock: str | None = None, sign: str | None = None, processing: bool = False, delay: str = "0 seconds", idle_ms: int | None = None) -> DataFrame:
    """(keys, end, aggregates, tick): every emission of every window; a later tick replaces an earlier one.

    The watermark follows ``clock``, less ``delay``. Where that is a time of arrival, rows may be as late by their own
    time as they like; where it is the row's own time, rows older than the watermark are dropped by Spark, but for
    those in a pack, so of one tick, with a row that is not.
    ``idle_ms``: a key without rows for so long is forgotten.
    """
    r = stream_rows(df, cfg, clock, sign)
    keys = [f"_k{i}" for i in range(len(cfg.key_fields))]
    kinds = [f"{k} {r.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*kinds, "end long", *[f"_a{n} {'double' if a.fn == 'sum' else 'long'}" for n, a in enumerate(cfg.group.aggregates)], "tick long"])
    r = r.mapInArrow(_packs(cfg, len(keys), processing), ", ".join([*kinds, *_pack_kinds(cfg)]))
    if not processing:
        r = r.withColumn("_at", F.timestamp_millis("high")).withWatermark("_at", delay)
    return r.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=WindowProcessor(cfg, len(keys), processing, idle_ms), outputStructType=schema, outputMode="Append", timeMode="ProcessingTime" if processing else "EventTime"
    )


def windowed_stream(df: DataFrame, cfg: WindowConfig, **how) -> DataFrame:
    """The streaming form of ``operators.windows.windowed``: fields and aggregates by position, revisions as further rows."""
    return W.output(revised_stream(df, cfg, **how), cfg)
