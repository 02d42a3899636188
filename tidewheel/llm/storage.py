"""Shared scratch folders and small plan helpers.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which all executors and the
driver share, so a lost executor costs only the task that it ran. A folder is made here only where
the setting is missing and the master is local, as in tests.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Arrow batches handed to Python stay under this many bytes, so long texts don't pile up.
BATCH_BYTES = 16 << 20
#: Bits of the bitmap (8 MB) that keeps rows out of a shuffle.
SIFT = 1 << 26
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: dict[str, str] = {}
#: Folders made inside the innermost ``settled``.
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder; raises on a cluster that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return qualified(spark, root)
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    return _own.setdefault(app, "file://" + tempfile.mkdtemp(prefix="tidewheel-"))


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme and host that Spark reads it by: without a scheme it is of the default file system.

    Formats that Spark has no writer for are written by other means, which would take it for a local path.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path.rstrip("/") or "/")
    whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return "file://" + whole[5:] if whole.startswith("file:/") and not whole.startswith("file://") else whole


def new_folder(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/tidewheel/{label}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


def materialise(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    The shuffle files of the write go at its end; nothing asks for them again.
    """
    spark, path = df.sparkSession, new_folder(df.sparkSession, label)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> DataFrame:
    """What ``make`` gives, materialised; the folders that it made on the way are deleted once that is written."""
    made: list[str] = []
    token = _made.set(made)
    try:
        df = make()
    finally:
        _made.reset(token)
    out = materialise(df, label)
    for path in made:
        remove(spark, path)
    free_shuffles(spark)
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of frames that are no longer referenced."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


@contextmanager
def narrow_rows(spark: SparkSession, rows: int = 1 << 16) -> Iterator[None]:
    """Larger Arrow batches for what is written inside: rows of a few numbers, which the bound on bytes holds as well."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        yield
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` for mapInArrow; at the end of a task the worker, which Spark keeps, hands freed memory back."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the GNU C library has it
            if trim:
                trim(0)

    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores ahead as it takes not to clash with a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        taken.add(n.lower())
        out.append(n)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once a row however often it is used."""
    return F.transform(F.array(value), body)[0]


def small(df: DataFrame, rows: int, width: Column | None = None) -> bool:
    """Whether a materialised table has at most ``rows`` rows: the check ahead of a broadcast.

    ``width`` is the size of a row in units of a plain one (two or three longs), for rows that hold arrays.
    """
    if df.limit(rows + 1).count() > rows:
        return False
    return width is None or (df.agg(F.sum(width)).first()[0] or 0) <= rows


def sifted(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """``df`` without most rows whose ``node`` is not in ``nodes``: what may stay of it ahead of a shuffled join with ``nodes``.

    The hashes of ``nodes`` go to a bitmap of ``SIFT`` bits, which is broadcast and never larger, however many they are.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.pmod(F.xxhash64("node", F.lit(2)), F.lit(SIFT))
    at, bit = F.floor(place / (1 << 15)).cast("int"), F.pmod(place, F.lit(1 << 15))
    bits = nodes.select(at.alias("_at"), bit.alias("_bit")).repartition(n, "_at").groupBy("_at").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    rows = df.withColumns({"_at": at, "_bit": bit}).join(F.broadcast(bits), "_at")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return rows.filter(F.getbit(byte, F.pmod(F.col("_bit"), F.lit(8)).cast("int")) == 1).select(*df.columns)


def maybe_broadcast(df: DataFrame, rows: int = 200_000, width: Column | None = None) -> DataFrame:
    """Mark a materialised table for broadcast if it is small, else leave it to a shuffled join."""
    return F.broadcast(df) if small(df, rows, width) else df
