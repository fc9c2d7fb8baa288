"""Usage quotas."""

from pyspark.sql import functions as F

from glosspark.registry import query


@query(
    "quota_daily",
    "A1 P10 P11",
    """
SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS used,
       CASE user_id % 3 WHEN 0 THEN 170 WHEN 1 THEN 4000 ELSE 10000 END AS quota,
       count(*) >= CASE user_id % 3 WHEN 0 THEN 170 WHEN 1 THEN 4000 ELSE 10000 END AS over_quota
FROM (SELECT ts, CASE WHEN user_id % 2 = 0 THEN 0 ELSE user_id END AS user_id FROM events) GROUP BY user_id, CAST(ts AS DATE)""",
)
def quota_daily(spark, sf_dir):
    plan = F.element_at(F.array(F.lit("free"), F.lit("pro"), F.lit("promax")), (F.col("user_id") % 3 + 1).cast("int"))
    quota = F.when(plan == "pro", 4000).when(plan == "promax", 10000).otherwise(170)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("user_id", F.when(F.col("user_id") % 2 == 0, 0).otherwise(F.col("user_id")))
    used = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("used"))
    return used.withColumn("quota", quota).withColumn("over_quota", F.col("used") >= F.col("quota"))
