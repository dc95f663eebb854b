"""Structured Streaming twins (st01-st09). Each takes a streaming (or static) frame and returns one; `run_once` drives a
stream over what is there, writes it with a checkpoint in the shared folder, and reads the result."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType


@cache
def _own_folder(application: str) -> str:
    """Only where spark.checkpoint.dir is unset, as on one machine."""
    return tempfile.mkdtemp(prefix="dealspark-")


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or _own_folder(spark.sparkContext.applicationId)
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def read_events(spark: SparkSession, sf_dir: str, name: str = "events", files_per_trigger: int | None = None) -> DataFrame:
    """st01, st02: a table as a file stream; new files are found by the source and remembered by its checkpoint."""
    table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    schema = table.schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if any(f"/{name}.parquet/" in f for f in table.inputFiles()):
        df = reader.parquet(f"{sf_dir}/{name}.parquet")
    else:  # the source reads folders: a table of one file is found by its name
        df = reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    # event times need the session's time zone
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if "ts" in df.columns else df


def run_once(df: DataFrame, mode: str = "append") -> DataFrame:
    spark = df.sparkSession
    base = shared_folder(spark)
    if mode == "append":
        df.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(df.schema).parquet(f"{base}/out")

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/{epoch}")

    query = df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress["batchId"] if query.lastProgress else 0
    return spark.read.schema(df.schema).parquet(f"{base}/out/{last}")


def daily_activity(events: DataFrame) -> DataFrame:
    """st03."""
    counted = events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.to_date("window.start").alias("day"), "event_type", "n")


def sessions(events: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """st04: sessions of a user that end after an idle time."""
    s = events.withWatermark("ts", "1 hour").groupBy("user_id", F.session_window("ts", idle)).agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def concurrent_sessions(sessions: DataFrame, user: str, limit: int = 3) -> DataFrame:
    """st04: the most sessions a user has open at once, and whether that is over the limit. One that ends when another
    starts doesn't count with it."""
    edges = sessions.select(user, F.explode(F.array(F.struct(F.col("started").alias("at"), F.lit(1).alias("step")), F.struct(F.col("ended").alias("at"), F.lit(-1).alias("step")))).alias("e")).groupBy(user, "e.at").agg(F.sum("e.step").alias("step"))
    open_now = F.sum("step").over(Window.partitionBy(user).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return edges.select(user, open_now.alias("open")).groupBy(user).agg(F.max("open").alias("most")).withColumn("over_limit", F.col("most") > limit)


def rate_windows(events: DataFrame) -> DataFrame:
    """st05, alerts: requests per user and action in windows of an hour that slide by five minutes."""
    c = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "60 minutes", "5 minutes"), "user_id", "event_type").agg(F.count("*").alias("n"))
    return c.select(F.col("window.start").alias("start"), "user_id", "event_type", "n")


def dedupe_ttl(events: DataFrame, keys: list[str], minutes: int = 5) -> DataFrame:
    """st07: one event per key and bucket of some minutes."""
    bucket = F.window("ts", f"{minutes} minutes")["start"]
    return events.withWatermark("ts", "1 hour").withColumn("bucket", bucket).dropDuplicatesWithinWatermark([*keys, "bucket"]).select(*keys, "bucket")


def classify_emails(emails: DataFrame) -> DataFrame:
    """st08: stateless classification of arriving mails."""
    from dealspark.operators.classify import classify_email, email_intent

    b = F.col("body")
    return emails.select("id", email_intent(b)["intent"].alias("reply"), classify_email(b)["intent"].alias("intent"))


class Epochs:
    """A folder that foreachBatch writes: tables with a part for each epoch, and a manifest of each epoch, written last. What
    an epoch does follows from its batch and the manifests before it, so one that runs again writes the same again; parts
    without a manifest are not read. A manifest has the newest time so far (microseconds) and its batch's number of late rows."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self.write(spark.createDataFrame([], "newest long, late long"), "manifest", -1)

    def write(self, df: DataFrame, table: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.base}/{table}/epoch={epoch}")

    def manifests(self) -> DataFrame:
        return self.spark.read.schema("newest long, late long, epoch int").parquet(f"{self.base}/manifest")

    def newest(self, before: int | None = None) -> int | None:
        """The newest time of all epochs, or of those before one: batches are numbered without gaps, so one manifest tells."""
        if before is None:
            return self.manifests().agg(F.max("newest")).first()[0]
        row = self.spark.read.schema("newest long, late long").parquet(f"{self.base}/manifest/epoch={before - 1}").first()
        return row["newest"] if row else None

    def commit(self, epoch: int, newest: int | None, late: int) -> None:
        self.write(self.spark.createDataFrame([(newest, late)], "newest long, late long").coalesce(1), "manifest", epoch)

    def read(self, table: str, schema: StructType, before: int | None = None) -> DataFrame:
        """Rows of committed epochs, or of those before one."""
        done = self.manifests().select("epoch")
        done = done if before is None else done.where(F.col("epoch") < before)
        whole = StructType([*schema.fields, StructField("epoch", IntegerType())])
        if done.isEmpty():
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(f"{self.base}/{table}").join(F.broadcast(done), "epoch", "left_semi")

    def late(self) -> int:
        return self.manifests().agg(F.coalesce(F.sum("late"), F.lit(0))).first()[0]

    def run(self, df: DataFrame, sink: Callable[[DataFrame, int, int | None, int | None], DataFrame], version: str) -> None:
        """Runs the stream over what is there. sink: batch, epoch, the newest time before and with it; it returns the late rows."""

        def each(batch: DataFrame, epoch: int) -> None:
            batch.persist()
            try:
                before, own = self.newest(epoch), batch.agg(F.max(F.unix_micros(version))).first()[0]
                newest = max((t for t in (before, own) if t is not None), default=None)
                late = sink(batch, epoch, before, newest)
                self.write(late, "late", epoch)
                self.commit(epoch, newest, self.spark.read.schema(late.schema).parquet(f"{self.base}/late/epoch={epoch}").count())
            finally:
                batch.unpersist()

        df.writeStream.foreachBatch(each).option("checkpointLocation", f"{self.base}/checkpoint").trigger(availableNow=True).start().awaitTermination()


def _less(newest: int | None, delay: str) -> Column:
    return F.timestamp_micros(F.lit(newest).cast("long")) - F.expr(f"interval {delay}")


def upsert_stream(df: DataFrame, key: str, version: str, late_after: str, base: str | None = None) -> tuple[DataFrame, DataFrame]:
    """st08: upserts by key with a table of late rows. A row is late when it is older than the newest of all by more than
    `late_after`. Every epoch logs its rows once and moves the watermark kept in the manifests; rows that are under it, of
    this batch or of an earlier one that it has now passed, go to the late table, so the same rows give the same two tables
    however they are split and ordered. Only the times between the old and the new watermark are read again. Rows without a
    version are late. base: the folder to go on with. Returns (newest version of each key among the rows in time, late rows)."""
    epochs = Epochs(df.sparkSession, base or shared_folder(df.sparkSession))

    def sink(batch: DataFrame, epoch: int, before: int | None, newest: int | None) -> DataFrame:
        epochs.write(batch, "rows", epoch)
        passed = batch.where(F.coalesce(F.col(version) < _less(newest, late_after), F.lit(True)))
        if before is None or newest == before:
            return passed
        between = (F.col(version) >= _less(before, late_after)) & (F.col(version) < _less(newest, late_after))
        return passed.unionByName(epochs.read("rows", df.schema, epoch).where(between).select(*df.columns))

    epochs.run(df, sink, version)
    in_time = epochs.read("rows", df.schema).where(F.col(version) >= _less(epochs.newest(), late_after))
    one = F.max_by(F.struct(*df.columns), F.struct(version, "epoch")).alias("r")
    return in_time.groupBy(F.col(key).alias("_key")).agg(one).select("r.*"), epochs.read("late", df.schema).select(*df.columns)


def windows_and_late(df: DataFrame, delay: str = "1 hour", window_minutes: int = 60, base: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """st09: counts per window, and the rows that came after their window was closed: the newest time of all batches before
    theirs, less the delay, had reached the window's end. Every epoch adds its counts and keeps its late rows and their
    number, so nothing is forgotten however many batches there are. Rows without a time are late. Returns counts (start, n), late
    rows, and the number of late rows."""
    epochs = Epochs(df.sparkSession, base or shared_folder(df.sparkSession))
    size = window_minutes * 60
    start = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / size) * size)

    def sink(batch: DataFrame, epoch: int, before: int | None, newest: int | None) -> DataFrame:
        open_ = F.col("ts").isNotNull() if before is None else F.coalesce(start + F.expr(f"interval {size} seconds") > _less(before, delay), F.lit(False))
        epochs.write(batch.where(open_).groupBy(start.alias("start")).agg(F.count("*").alias("n")), "counts", epoch)
        return batch.where(~open_)

    epochs.run(df, sink, "ts")
    total = epochs.read("counts", StructType.fromDDL("start timestamp, n long")).groupBy("start").agg(F.sum("n").alias("n"))
    return total, epochs.read("late", df.schema).select(*df.columns), epochs.late()


def late_rows(df: DataFrame) -> tuple[DataFrame, int]:
    """st09: counts per hour, and the number of rows that came too late for theirs."""
    counts, _, late = windows_and_late(df)
    return counts, late
