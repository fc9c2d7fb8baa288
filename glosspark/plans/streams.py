"""Streams over ``events``, run to the end of what is there and held against batch SQL."""

import tempfile
import uuid

from pyspark.sql import functions as F

from glosspark.plans.logs import SAVED
from glosspark.registry import query
from glosspark.streaming import logs


def _places(spark):
    """A folder that executors share, for output and checkpoints of one run."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="streams-")
    base = f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/state"


def stream(spark, sf_dir):
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("created_at", F.col("ts").cast("timestamp"))


@query("stream_daily_quota", "ST1", "SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS used FROM events GROUP BY user_id, CAST(ts AS DATE)")
def stream_daily_quota(spark, sf_dir):
    return logs.latest(logs.run_to_table(logs.daily_use(stream(spark, sf_dir)), *_places(spark)), "user_id", "day")


@query(
    "stream_exact_saves", "ST2",
    f"""WITH RECURSIVE x AS (SELECT {SAVED[0]} AS u, {SAVED[1]} AS e, ts FROM events), s AS (SELECT *, row_number() OVER (PARTITION BY u, e ORDER BY ts) AS k FROM x),
w AS (SELECT u, e, k, ts, ts AS last, true AS kept FROM s WHERE k = 1
      UNION ALL SELECT s.u, s.e, s.k, s.ts, CASE WHEN s.ts - w.last > INTERVAL 2 MINUTES THEN s.ts ELSE w.last END, s.ts - w.last > INTERVAL 2 MINUTES
      FROM w JOIN s ON s.u = w.u AND s.e = w.e AND s.k = w.k + 1)
SELECT u, e, epoch_us(ts) AS t FROM w WHERE kept""",
)
def stream_exact_saves(spark, sf_dir):
    keyed = stream(spark, sf_dir).select(F.expr(SAVED[0]).alias("u"), F.expr(SAVED[1]).alias("e"), "created_at")
    kept = logs.run_to_table(logs.exact_saves(keyed, ("u", "e")), *_places(spark))
    names = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(SAVED[0]).alias("u"), F.expr(SAVED[1]).alias("e")).distinct().withColumn("k", F.xxhash64("u", "e"))
    return kept.join(names, "k").select("u", "e", "t")


@query("stream_job_state", "ST3 X7", "SELECT user_id AS job_id, arg_max(status, event_id) AS status, CAST(arg_max(least(100, greatest(0, CAST(floor(value) AS INTEGER))), event_id) AS INTEGER) AS progress, arg_max(props, event_id) AS message FROM (SELECT *, CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'in_progress' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'unknown' END AS status FROM events) GROUP BY user_id")
def stream_job_state(spark, sf_dir):
    status = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in (("view", "pending"), ("click", "in_progress"), ("purchase", "completed"), ("error", "failed"))], F.lit("unknown"))
    events = stream(spark, sf_dir).select(F.col("user_id").alias("job_id"), F.col("created_at").alias("ts"), status.alias("status"), F.floor("value").cast("int").alias("progress"), F.col("props").alias("message"))
    return logs.latest(logs.run_to_table(logs.job_state(events), *_places(spark)), "job_id")


@query("stream_saves", "ST2")
def stream_saves(spark, sf_dir):
    keyed = stream(spark, sf_dir).select(F.expr(SAVED[0]).alias("u"), F.expr(SAVED[1]).alias("e"), "created_at")
    return logs.run_to_table(logs.saves(keyed, key=("u", "e")), *_places(spark), mode="append").drop("__batch")
