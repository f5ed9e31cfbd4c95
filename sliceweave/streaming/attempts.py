"""Incremental roll-up of the append-only attempt log.

Every trigger appends one small table of partial results. Every ``COMPACT`` triggers the tables so far are merged into a new
version of the compacted table, which a pointer names together with the last trigger in it; readers add only the tables of
later triggers. Tables that a compaction has merged go at the next one, so what a reader opens stays bounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sliceweave.sources import snapshots

#: Triggers after which partial results are merged.
COMPACT = 10
TOKENS = ["input_tokens", "output_tokens", "total_tokens"]


def read_attempts(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def usage_by_window(attempts: DataFrame, width: str) -> DataFrame:
    """Attempts, failures and token totals per time window; the same for a batch and for a stream."""
    return attempts.groupBy(F.window("started_at", width)).agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("status") != "SUCCESS").alias("failures"),
        *[F.sum(name).alias(name) for name in TOKENS], F.count_if(F.col("total_tokens").isNull()).alias("attempts_without_usage"),
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
             "attempts", "failures", *TOKENS, "attempts_without_usage")


def _held(spark: SparkSession, out: str) -> tuple[str | None, int]:
    """Folder of the compacted table and the last trigger in it."""
    folder = snapshots.current(spark, f"{out}/_compacted")
    return folder, -1 if folder is None else spark.read.parquet(f"{folder}/upto").first()["upto"]


def partial_rows(spark: SparkSession, out: str) -> DataFrame:
    """The compacted rows and the partial rows of later triggers."""
    folder, upto = _held(spark, out)
    later = spark.read.parquet(out).where(F.col("version") > upto).drop("version")
    return later if folder is None else spark.read.parquet(f"{folder}/rows").unionByName(later)


def compact(spark: SparkSession, out: str, merge: Callable[[DataFrame], DataFrame], upto: int) -> None:
    """Merge all triggers up to ``upto``, which must be written whole, and drop the tables that were merged before."""
    _, before = _held(spark, out)
    if upto <= before:
        return
    rows = merge(partial_rows(spark, out))

    def write(folder: str) -> None:
        rows.write.parquet(f"{folder}/rows")
        spark.range(1).select(F.lit(upto).alias("upto")).write.parquet(f"{folder}/upto")

    snapshots.publish(spark, f"{out}/_compacted", write)
    system, root = snapshots.files(spark, out)
    for status in system.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("version=") and int(name.removeprefix("version=")) <= before:
            system.delete(status.getPath(), True)
    snapshots.remove_old(spark, f"{out}/_compacted", keep=2)


def writer(partial: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame], out: str, every: int = COMPACT) -> Callable[[DataFrame, int], None]:
    """What a trigger does. A repeated trigger rewrites its own table; if that was merged already, the table is not read again."""
    def write(batch: DataFrame, version: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{out}/version={version}")
        if (version + 1) % every == 0:
            compact(batch.sparkSession, out, merge, version)

    return write


def _start(attempts: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    return attempts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def start_usage(attempts: DataFrame, out: str, checkpoint: str, width: str = "1 day") -> StreamingQuery:
    """Partial usage per window and trigger. No row is late: a window that comes up again adds another partial row."""
    return _start(attempts, writer(lambda batch: usage_by_window(batch, width), _summed, out), checkpoint)


def _summed(rows: DataFrame) -> DataFrame:
    counts = ["attempts", "failures", *TOKENS, "attempts_without_usage"]
    return rows.groupBy("window_start", "window_end").agg(*[F.sum(c).alias(c) for c in counts])


def usage(spark: SparkSession, out: str) -> DataFrame:
    """Usage per window so far, open windows included: the partial rows of all triggers added up."""
    return _summed(partial_rows(spark, out))


def latest_state(attempts: DataFrame) -> DataFrame:
    """Latest status and attempt count per key."""
    return attempts.groupBy("uid").agg(
        F.max("attempt").alias("attempt"), F.max_by("status", "attempt").alias("status"), F.count(F.lit(1)).alias("attempts"))


def start_latest(attempts: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Partial latest states per trigger, of the keys that the trigger brings."""
    return _start(attempts, writer(latest_state, _newest, out), checkpoint)


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("uid").agg(F.max("attempt").alias("attempt"), F.max_by("status", "attempt").alias("status"), F.sum("attempts").alias("attempts"))


def latest(spark: SparkSession, out: str) -> DataFrame:
    """Latest state per key over all triggers so far."""
    return _newest(partial_rows(spark, out))
