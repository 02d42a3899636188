"""The detail table: what a retraction needs to know of earlier rows.

A row becomes (hkey, field, value): a hash name, a primary key and the joined values. The table stands for
a key-value store of hashes; ``DetailStore`` is the interface that another store would fill.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewheel.functions.timeutil import format_day, format_text
from tidewheel.plans.config import DetailConfig

SCHEMA = "hkey string, field string, value string"


def hash_key(df: DataFrame, prefix: str, suffix: str) -> Column:
    """A constant, or with ``field_N`` column N and the suffix; blank is an error."""
    if not prefix.startswith("field_"):
        key = F.lit(prefix)
    else:
        key = F.concat(F.coalesce(F.col(f"`{df.columns[int(prefix[6:])]}`").cast("string"), F.lit("")), F.lit(suffix))
    return F.when(F.trim(key) == "", F.raise_error(F.lit("blank hash key")).cast("string")).otherwise(key)


def build(df: DataFrame, cfg: DetailConfig, order: str | None = None) -> DataFrame:
    """hkey, field, value for every row, in the order of ``order`` if it is given (column ``_at``)."""
    name = F.col(f"`{df.columns[cfg.field]}`").cast("string")
    name = F.when(name.isNull() | (F.trim(name) == ""), F.raise_error(F.lit("blank detail field")).cast("string")).otherwise(name)
    values = [F.coalesce(F.col(f"`{df.columns[i]}`").cast("string"), F.lit("null")) for i in cfg.values]
    at = [F.col(order).alias("_at")] if order else []
    return df.select(hash_key(df, cfg.prefix, cfg.suffix).alias("hkey"), name.alias("field"), F.concat_ws(cfg.split, *values).alias("value"), *at)


def resolve(built: DataFrame, first: bool) -> DataFrame:
    """One value for each (hkey, field) of a batch: the first write if it must not exist, else the last."""
    by = F.min_by if first else F.max_by
    return built.groupBy("hkey", "field").agg(by("value", "_at").alias("value"))


def absent(batch: DataFrame, store: DataFrame) -> DataFrame:
    """Rows whose (hkey, field) has no value in the store yet."""
    held = store.filter("value is not null and trim(value) <> ''")
    return batch.join(held.select("hkey", "field"), ["hkey", "field"], "left_anti")


def audit(batch: DataFrame, clock_s: Column | None = None) -> DataFrame:
    """What was written, with the local day and time of the write."""
    now = F.unix_timestamp(F.current_timestamp()) if clock_s is None else clock_s
    return batch.select(format_day(now).alias("date"), format_text(now).alias("datetime"), "hkey", "field", "value")


class DetailStore:
    """Hashes, strings and lists in Parquet: each write appends what it changes, a read takes the last of each field.

    A write is a folder of its own, named by its time and a unique name, so that writers don't meet; Spark's
    mark of success tells whole writes from broken ones. ``compact`` writes the state as one folder and drops what
    came before it. A hash whose time is over starts anew with the next write.
    """

    COLUMNS = "kind string, hkey string, field string, value string, seq string, at_s long, ends_s long"

    def __init__(self, spark: SparkSession, folder: str, tries: int = 3, wait_s: float = 5.0, clock: Callable[[], float] = time.time):
        self.spark, self.folder, self.tries, self.wait_s, self.clock = spark, folder.rstrip("/"), tries, wait_s, clock

    def __enter__(self) -> DetailStore:
        return self

    def __exit__(self, *_: Any) -> None:
        return None

    def _again(self, what: Callable[[], Any]) -> Any:
        """``what`` with retries; an error that the data raise is not tried again."""
        for n in range(self.tries):
            try:
                return what()
            except (OSError, PySparkException, Py4JError) as e:
                if "USER_RAISED_EXCEPTION" in str(e):
                    raise
                if n + 1 == self.tries:
                    raise ConnectionError("the detail store can't be reached") from e
                time.sleep(self.wait_s)

    def _path(self, name: str = "") -> Any:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _fs(self) -> Any:
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _writes(self) -> list[str]:
        """The whole writes in order, from the last compacted one on."""
        fs = self._fs()
        if not fs.exists(self._path()):
            return []
        names = sorted(x.getPath().getName() for x in fs.listStatus(self._path()))
        names = [n for n in names if fs.exists(self._path(f"{n}/_SUCCESS"))]
        whole = [i for i, n in enumerate(names) if n.endswith("-all")]
        return names[whole[-1] :] if whole else names

    def _rows(self) -> DataFrame:
        """All rows of the current life of each hash."""
        names = self._writes()
        if not names:
            return self.spark.createDataFrame([], self.COLUMNS.replace("ends_s long", "since string, until long"))
        rows = self.spark.read.schema(self.COLUMNS).parquet(*[f"{self.folder}/{n}" for n in names])
        # A few rows a hash: one for each write that touched it.
        touched = rows.groupBy("kind", "hkey", "seq").agg(F.max("at_s").alias("at_s"), F.max("ends_s").alias("ends_s"))
        w = Window.partitionBy("kind", "hkey").orderBy("seq")
        before = F.last("ends_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        lives = touched.withColumn("life", F.sum(F.when(before <= F.col("at_s"), 1).otherwise(0)).over(w))
        last = lives.groupBy("kind", "hkey").agg(F.max("life").alias("life"))
        last = lives.join(last, ["kind", "hkey", "life"]).groupBy("kind", "hkey").agg(F.min("seq").alias("since"), F.max_by("ends_s", F.when(F.col("ends_s").isNotNull(), F.col("seq"))).alias("until"))
        now = int(self.clock())
        last = last.filter(F.col("until").isNull() | (F.col("until") > now))
        return rows.drop("ends_s").join(last, ["kind", "hkey"]).filter(F.col("seq") >= F.col("since"))

    def _current(self, kind: str) -> DataFrame:
        rows = self._again(self._rows).filter(F.col("kind") == kind)
        return rows.groupBy("hkey", "field").agg(F.max_by("value", "seq").alias("value"), F.max("until").alias("expires_at"))

    def read(self) -> DataFrame:
        """(hkey, field, value, expires_at) of all hashes."""
        return self._current("hash")

    def _append(self, kind: str, batch: DataFrame, expire_s: int, mark: str = "") -> None:
        now = self.clock()
        name = f"{int(now * 1_000_000):020d}-{uuid.uuid4().hex}{mark}"
        ends = F.lit(int(now) + expire_s if expire_s > 0 else None).cast("long")
        rows = batch.select(F.lit(kind).alias("kind"), "hkey", "field", "value", F.lit(name).alias("seq"), F.lit(int(now)).cast("long").alias("at_s"), ends.alias("ends_s"))
        self._again(lambda: rows.sortWithinPartitions("hkey", "field").write.mode("overwrite").parquet(f"{self.folder}/{name}"))

    def write(self, batch: DataFrame, expire_s: int = 0) -> None:
        """Upsert; a written hash lives ``expire_s`` seconds more, all its fields with it."""
        self._append("hash", batch.select("hkey", "field", "value"), expire_s)

    def set(self, name: str, value: str, expire_s: int = 0) -> None:
        self._append("string", self.spark.createDataFrame([(name, "", value)], SCHEMA), expire_s)

    def lpush(self, name: str, *values: str, expire_s: int = 0) -> None:
        self._append("list", self.spark.createDataFrame([(name, f"{i:09d}", v) for i, v in enumerate(values)], SCHEMA), expire_s)

    def compact(self) -> None:
        """One folder in place of all writes so far, for a time without writers; a reader that has begun keeps its files until the next compaction."""
        old = self._writes()
        if len(old) < 2:
            return
        rows = self._again(self._rows)
        hashes = rows.filter("kind <> 'list'").groupBy("kind", "hkey", "field").agg(*[F.max_by(c, "seq").alias(c) for c in ("value", "at_s", "until")], F.max("seq").alias("seq"))
        every = hashes.unionByName(rows.filter("kind = 'list'").select(*hashes.columns)).withColumnRenamed("until", "ends_s")
        name = f"{old[-1]}-all"
        self._again(lambda: every.select(*[c.split()[0] for c in self.COLUMNS.split(", ")]).write.mode("overwrite").parquet(f"{self.folder}/{name}"))
        fs = self._fs()
        dead = [n for n in sorted(x.getPath().getName() for x in fs.listStatus(self._path())) if n < old[0]]
        for n in dead:
            fs.delete(self._path(n), True)

    def hget(self, hkey: str, name: str) -> str | None:
        row = self._again(lambda: self.read().filter((F.col("hkey") == hkey) & (F.col("field") == name)).select("value").first())
        return row[0] if row else None

    def get(self, name: str) -> str | None:
        row = self._again(lambda: self._current("string").filter(F.col("hkey") == name).select("value").first())
        return row[0] if row else None

    def lrange(self, name: str) -> DataFrame:
        """(value, seq, field) of a list; its head is the last in the order of seq, then field."""
        return self._again(self._rows).filter((F.col("kind") == "list") & (F.col("hkey") == name)).select("value", "seq", "field").orderBy(F.desc("seq"), F.desc("field"))

    def hgetall(self, hkey: str) -> DataFrame:
        return self.read().filter(F.col("hkey") == hkey).select("field", "value")

    def hkeys(self, hkey: str) -> DataFrame:
        return self.hgetall(hkey).select("field")

    def hmget(self, hkey: str, names: DataFrame) -> DataFrame:
        return self.hgetall(hkey).join(names, "field", "left_semi")

    def exists(self, hkey: str) -> bool:
        return bool(self._again(lambda: not self._rows().filter(F.col("hkey") == hkey).isEmpty()))


def write_details(df: DataFrame, cfg: DetailConfig, store: DetailStore, order: str) -> DataFrame:
    """The detail job on one batch; gives the rows that were written."""
    built = build(df, cfg, order)
    if cfg.check_exists:
        built = absent(built, store.read())
    batch = resolve(built, cfg.check_exists)
    store.write(batch, cfg.expire_s)
    return audit(batch) if cfg.audit else batch
