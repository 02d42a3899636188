"""The configuration surface: job parameters, the field list and the aggregate list."""

from __future__ import annotations

import json
from dataclasses import dataclass

from tidewheel.functions.timeutil import DAY_MS, ZONE_MS

TIMES = ("starttime", "starttime_10", "starttime_13", "endtime", "endtime_10", "endtime_13")


@dataclass(frozen=True)
class Aggregate:
    """``fn``: count, sum, distinct, distinct_int or distinct_long, over input column ``index``."""

    spec: str
    fn: str
    index: int

    @classmethod
    def parse(cls, spec: str) -> Aggregate:
        parts = spec.split("_")
        if len(parts) not in (2, 3) or not parts[-1].isdigit():
            raise ValueError(f"unmatch group type {spec}")
        fn = parts[0]
        if fn == "distinct":
            fn = f"distinct_{parts[1]}" if len(parts) == 3 and parts[1] in ("int", "long") else "distinct"
        elif fn not in ("count", "sum"):
            raise ValueError(f"unmatch group type {spec}")
        return cls(spec, fn, int(parts[-1]))

    @property
    def is_distinct(self) -> bool:
        return self.fn.startswith("distinct")


@dataclass(frozen=True)
class GroupSchema:
    """Output fields, then aggregates, by position; names are the specifications."""

    fields: tuple[str, ...]
    aggregates: tuple[Aggregate, ...]

    @classmethod
    def parse(cls, text: str) -> GroupSchema:
        spec = json.loads(text)
        for f in spec["field"]:
            if f not in TIMES and f != "key" and not (f.startswith("key_") and all(x.isdigit() for x in f.split("_")[1:]) and len(f.split("_")) in (2, 3)):
                raise ValueError(f"unmatch key type {f}")
        return cls(tuple(spec["field"]), tuple(Aggregate.parse(g) for g in spec["group"]))


@dataclass(frozen=True)
class Retraction:
    """Which detail hash to subtract, and where its text holds time and values."""

    prefix: str
    suffix: str = ""
    field: int = 0
    value_time: int = 0
    value_map: tuple[tuple[int, int], ...] = ()
    split: str = ","

    @staticmethod
    def parse_map(text: str) -> tuple[tuple[int, int], ...]:
        return tuple((int(a), int(b)) for a, b in (x.split("=") for x in text.split(";") if x))


@dataclass(frozen=True)
class WindowConfig:
    """One windowed aggregation. Times are milliseconds."""

    key_fields: tuple[int, ...]
    time_field: int
    size: int
    slide: int
    group: GroupSchema
    lateness: int = 0
    trigger_late: int = 0
    keep_old: bool = False
    keep_late_zero: int = 0
    always: bool = True
    start_zero: bool = False
    recount: bool = True
    retraction: Retraction | None = None
    zone_ms: int = ZONE_MS
    strict: bool = False

    def __post_init__(self) -> None:
        if not 0 < self.slide <= self.size:
            raise ValueError("slide.size must be above 0 and at most window.size")
        if not self.key_fields:
            raise ValueError("key.fields is required")
        if self.start_zero and self.keep_late_zero > max(self.slide, self.size - DAY_MS):
            raise ValueError("keep.late.zero.time may not exceed window.size less a day")

    @property
    def split(self) -> int:
        return self.size // self.slide

    @property
    def reach(self) -> int:
        """The effective size: whole slides only."""
        return self.split * self.slide

    @property
    def late_limit(self) -> int:
        return self.keep_late_zero or self.slide


def _flag(p: dict[str, str], name: str, default: bool) -> bool:
    return str(p.get(name, default)).strip().lower() == "true"


@dataclass(frozen=True)
class JobConfig:
    """Parameters of the window job, under their public names."""

    window: WindowConfig
    input_table: str
    output_table: str
    input_type: str = "source"
    output_type: str = "sink"
    where: str = ""
    select: str = "*"
    uid: str = "default"
    detail_table: str | None = None
    idle_state_s: tuple[int, int] | None = None
    time_type: str = "event"
    store_address: str | None = None
    store_port: int = 9100
    store_password: str | None = None

    @classmethod
    def from_params(cls, p: dict[str, str]) -> JobConfig:
        if (time_type := p.get("stream.time.type", "event").lower()) not in ("event", "processing"):
            raise ValueError(f"{time_type} time is not supported")
        for k in ("input.table.name", "output.table.name", "window.size", "slide.size", "time.field", "group.string", "key.fields"):
            if not p.get(k):
                raise ValueError(f"{k} is required")
        if (kind := p.get("input.table.type", "source")) not in ("source", "buffer"):
            raise ValueError(f"unknown input.table.type {kind}")
        if (kind := p.get("output.table.type", "sink")) not in ("sink", "buffer"):
            raise ValueError(f"unknown output.table.type {kind}")
        retraction = None
        if p.get("hkey.value.map"):
            retraction = Retraction(
                p.get("hkey.prefix", ""), p.get("hkey.suffix", ""), int(p.get("hkey.field", 0)), int(p.get("hkey.value.time", 0)), Retraction.parse_map(p["hkey.value.map"]), p.get("split.detail.char", ",")
            )
        window = WindowConfig(
            tuple(int(x) for x in p["key.fields"].split(",")),
            int(p["time.field"]),
            int(p["window.size"]),
            int(p["slide.size"]),
            GroupSchema.parse(p["group.string"]),
            int(p.get("lateness", 0)),
            int(p.get("trigger.late.ms", 0)),
            _flag(p, "keep.old.data", False),
            int(p.get("keep.late.zero.time", 0)),
            _flag(p, "always.calculate", True),
            _flag(p, "start.zero.time", False),
            _flag(p, "recount.late.data", False),
            retraction,
        )
        if bool(p.get("min.idle.state")) != bool(p.get("max.idle.state")):
            raise ValueError("min.idle.state and max.idle.state go together")
        idle = (int(p["min.idle.state"]), int(p["max.idle.state"])) if p.get("min.idle.state") and p.get("max.idle.state") else None
        return cls(
            window, p["input.table.name"], p["output.table.name"], p.get("input.table.type", "source"), p.get("output.table.type", "sink"), p.get("where", ""), p.get("select", "*"), p.get("uid", "default"), p.get("detail.table"), idle,
            time_type, p.get("redis.address"), int(p.get("redis.port", 9100)), p.get("redis.passwd")
        )


@dataclass(frozen=True)
class DetailConfig:
    """Parameters of the detail job."""

    prefix: str
    field: int
    values: tuple[int, ...]
    suffix: str = ""
    split: str = ","
    check_exists: bool = False
    audit: bool = False
    expire_s: int = 0

    @classmethod
    def from_params(cls, p: dict[str, str]) -> DetailConfig:
        for k in ("hkey.prefix", "hkey.field", "hkey.values"):
            if not str(p.get(k, "")):
                raise ValueError(f"{k} is required")
        return cls(
            p["hkey.prefix"], int(p["hkey.field"]), tuple(int(x) for x in p["hkey.values"].split(",")), p.get("hkey.suffix", ""), p.get("split.detail.char", ","), _flag(p, "check.exists", False), _flag(p, "print", False), int(p.get("redis.expire", 0))
        )
