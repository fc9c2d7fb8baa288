"""Log streams: daily quota, idempotent saves, state of jobs."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glosspark.operators.history import DUPLICATE_MINUTES, SAVE_KEY

RANK = {"pending": 0, "in_progress": 1, "completed": 2, "failed": 2}


def daily_use(log: DataFrame, delay: str = "1 hour", at: str = "created_at") -> DataFrame:
    """Uses of each user and UTC day; state of days past the watermark is dropped."""
    return log.withWatermark(at, delay).groupBy(F.window(at, "1 day"), "user_id").agg(F.count("*").alias("used")).select("user_id", F.to_date("window.start").alias("day"), "used")


def saves(log: DataFrame, minutes: int = DUPLICATE_MINUTES, key: tuple[str, ...] = SAVE_KEY, at: str = "created_at") -> DataFrame:
    """Saves without repeats within ``minutes``. The state may hold a key a little longer than that;
    the batch operator ``accepted_saves`` is exact."""
    return log.withWatermark(at, f"{minutes} minutes").dropDuplicatesWithinWatermark(list(key))


def _exact(key: tuple, rows: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    """Times kept for one key: more than two minutes after the last one kept."""
    if state.hasTimedOut:
        state.remove()
        return
    span = DUPLICATE_MINUTES * 60_000_000
    last = state.get[0] if state.exists else None
    out = []
    for t in sorted(x for b in rows for x in b["t"]):
        if last is None or t - last > span:
            out.append(t)
            last = t
    if last is not None:
        state.update((last,))
        state.setTimeoutTimestamp(max((last + span) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
    yield pd.DataFrame({"k": [key[0]] * len(out), "t": out})


def exact_saves(log: DataFrame, key: tuple[str, ...] = SAVE_KEY, at: str = "created_at", delay: str = "2 minutes") -> DataFrame:
    """(k, t): hash of the key and microseconds of saves kept, exactly by the two-minute rule for
    input whose batches are in order; one long of state for each key saved in the last minutes, as a key
    is forgotten once the watermark is two minutes past its last save."""
    rows = log.withWatermark(at, delay).select(at, F.xxhash64(*key).alias("k"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"))
    return rows.groupBy("k").applyInPandasWithState(_exact, "k bigint, t bigint", "last bigint", "update", "EventTimeTimeout")


def job_state(events: DataFrame) -> DataFrame:
    """Last status, progress (0 to 100) and message of each job; of equal times the later status.

    One aggregation for batch and stream; a stream runs it in update mode.
    """
    at = F.struct("ts", F.coalesce(*[F.when(F.col("status") == k, v) for k, v in RANK.items()], F.lit(-1)), "progress", "message")
    return events.groupBy("job_id").agg(F.max_by("status", at).alias("status"), F.greatest(F.lit(0), F.least(F.lit(100), F.max_by("progress", at))).alias("progress"), F.max_by("message", at).alias("message"))


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "update") -> DataFrame:
    """All that is there, once, into Parquet with the batch's number; gives the table written."""

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("__batch", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    schema = T.StructType([*stream.schema.fields, T.StructField("__batch", T.IntegerType())])
    query = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    spark: SparkSession = stream.sparkSession
    return spark.read.schema(schema).parquet(f"{path}/batch=*")


def latest(rows: DataFrame, *key: str) -> DataFrame:
    """The last version of each key of an update stream's table."""
    rest = [c for c in rows.columns if c not in key and c != "__batch"]
    return rows.groupBy(*key).agg(*[F.max_by(c, "__batch").alias(c) for c in rest])
