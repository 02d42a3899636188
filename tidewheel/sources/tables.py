"""Where rows come from and go to: catalog tables, views, streams, JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def input_table(spark: SparkSession, name: str, streaming: bool = False) -> DataFrame:
    """A registered table or an earlier job's buffer view, its times as timestamps."""
    df = spark.readStream.table(name) if streaming else spark.table(name)
    return coerce_times(df)


def coerce_times(df: DataFrame) -> DataFrame:
    """Time columns without a zone become timestamps of the session's zone."""
    return df.select(*[F.col(f"`{f.name}`").cast("timestamp").alias(f.name) if isinstance(f.dataType, T.TimestampNTZType) else F.col(f"`{f.name}`") for f in df.schema])


def finish(df: DataFrame, select: str = "*", where: str = "") -> DataFrame:
    """The SQL select list and predicate over a job's output."""
    df.createOrReplaceTempView(view := f"finish_{abs(id(df))}")
    return df.sparkSession.sql(f"SELECT {select or '*'} FROM {view}" + (f" WHERE {where}" if where.strip() else ""))


def output_table(df: DataFrame, name: str, kind: str) -> None:
    """Append to a sink table, or register a buffer view for the next job."""
    if kind == "buffer":
        df.createOrReplaceTempView(name)
    elif kind == "sink":
        df.write.mode("append").saveAsTable(name)
    else:
        raise ValueError(f"unknown output.table.type {kind}")


def kafka_text(spark: SparkSession, servers: str, topic: str, group: str) -> DataFrame:
    """Text messages of a topic from now on; needs Spark's Kafka package."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "kafka.group.id": group, "startingOffsets": "latest"}
    return spark.readStream.format("kafka").options(**options).load().select(F.col("value").cast("string").alias("value"))


def file_text(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Lines of text files as they come in."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)


def tokenize(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON text to (c1 string, c2 int, c3 long, c4 string, c5 timestamp); malformed rows go.

    c5 of 19 characters is local text, else epoch milliseconds.
    """
    raw = F.from_json(value, "c1 string, c2 int, c3 long, c4 string, c5 string")
    c5 = F.when(F.length("j.c5") == 19, F.try_to_timestamp("j.c5", F.lit("yyyy-MM-dd HH:mm:ss")) - F.expr("INTERVAL 8 HOURS"))
    c5 = c5.otherwise(F.timestamp_millis(F.col("j.c5").try_cast("long")))
    rows = lines.select(raw.alias("j")).filter("j is not null").select("j.c1", "j.c2", "j.c3", "j.c4", c5.alias("c5"))
    return rows.filter("c1 is not null and c2 is not null and c3 is not null and c4 is not null and c5 is not null")


def producer(spark: SparkSession, rows_per_second: int = 1) -> DataFrame:
    """Synthetic JSON messages, for trying out a job."""
    ms = F.unix_millis("timestamp")
    n = F.pmod("value", F.lit(3))
    row = F.struct(F.lit("a").alias("c1"), n.cast("int").alias("c2"), n.alias("c3"), ms.cast("string").alias("c4"), ms.alias("c5"))
    return spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load().select(F.to_json(row).alias("value"))


class Upsert:
    """A ``foreachBatch`` sink that keeps the row with the greatest ``order`` for each key.

    Each batch appends a folder of its own, written over if the batch is repeated, so a stream that goes on
    after a failure or from an older checkpoint loses and doubles nothing; the last rows are chosen on reading.
    """

    def __init__(self, folder: str, keys: list[str], order: str):
        self.folder, self.keys, self.order = folder, keys, order

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{self.folder}/batch={epoch}")

    def read(self, spark: SparkSession) -> DataFrame:
        rows = spark.read.parquet(self.folder).drop("batch")
        row = F.struct(*[F.col(f"`{c}`") for c in rows.columns if c != "_epoch"])
        return rows.groupBy(*self.keys).agg(F.max_by(row, F.struct(self.order, "_epoch")).alias("_r")).select("_r.*")


def console(df: DataFrame) -> StreamingQuery:
    return df.writeStream.format("console").outputMode("append").start()
