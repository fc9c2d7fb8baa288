"""Log queries. ``events`` stands in for the translation log and ``customer`` for its users."""

from pyspark.sql import functions as F

from glosspark.operators import history as h
from glosspark.plans.segments import _LINES, made_lines
from glosspark.registry import query

#: The stand-in log, as SQL that both engines read alike.
_FIELDS = {
    "id": "event_id",
    "user_id": "CASE WHEN event_id % 10 = 9 THEN NULL ELSE user_id END",
    "original_text": "CASE WHEN event_id % 17 = 0 THEN '  ' ELSE concat(event_type, ' ', props) END",
    "translated_text": "upper(event_type)",
    "source_lang": "'en'",
    "target_lang": "CASE WHEN event_id % 13 = 0 THEN ' ' ELSE 'vi' END",
    "file_path": "CASE WHEN event_type = 'purchase' THEN concat('in/File', CAST(event_id AS VARCHAR(20)), CASE event_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.docx' WHEN 2 THEN '.txt' WHEN 3 THEN '.JPeG' ELSE '.exe' END) WHEN event_type = 'error' THEN '' END",
    "created_at": "ts",
}
_LOG = "WITH log AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _FIELDS.items()) + " FROM events), usr AS (SELECT c_custkey AS id, c_name AS name, CASE c_custkey % 4 WHEN 0 THEN 'free' WHEN 1 THEN 'Pro' WHEN 2 THEN 'promax' END AS plan FROM customer WHERE c_custkey % 7 <> 3)\n"
_ISO = "strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f')"
_SHOWN = f"id, original_text, translated_text, source_lang, target_lang, coalesce(file_path, '') <> '' AS has_file, {_ISO} AS created_at"
_QUOTA = "CASE lower(trim(plan)) WHEN 'free' THEN 170 WHEN 'pro' THEN 4000 WHEN 'promax' THEN 10000 ELSE 170 END"


def log(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*[f"{v} AS {k}" for k, v in _FIELDS.items()])


def users(spark, sf_dir):
    plan = F.when(F.col("id") % 4 == 0, "free").when(F.col("id") % 4 == 1, "Pro").when(F.col("id") % 4 == 2, "promax")
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")).where("id % 7 <> 3").withColumn("plan", plan)


@query("history_page", "S1 P1 P4 O1 O2", _LOG + f"SELECT {_SHOWN} FROM (SELECT * FROM log WHERE user_id = 7 ORDER BY log.created_at DESC, id DESC LIMIT 10 OFFSET 10)")
def history_page(spark, sf_dir):
    return h.shown(h.page(h.history(log(spark, sf_dir), 7), 2, 10))


@query("history_text_only", "P2", _LOG + f"SELECT {_SHOWN} FROM log WHERE file_path IS NULL AND user_id = 12")
def history_text_only(spark, sf_dir):
    return h.shown(h.history(log(spark, sf_dir), 12, "text"))


@query("history_documents", "P2 P4", _LOG + f"SELECT {_SHOWN} FROM log WHERE file_path IS NOT NULL AND user_id = 12")
def history_documents(spark, sf_dir):
    return h.shown(h.history(log(spark, sf_dir), 12, "document"))


@query("history_by_day", "P3", _LOG + f"SELECT {_SHOWN} FROM log WHERE CAST(created_at AS DATE) = DATE '2024-01-05'")
def history_by_day(spark, sf_dir):
    return h.shown(h.history(log(spark, sf_dir), day="2024-1-5"))


@query("history_latest", "P5 O3", _LOG + "SELECT id, user_id, original_text FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS k FROM log) WHERE k = 1")
def history_latest(spark, sf_dir):
    return h.newest(log(spark, sf_dir)).select("id", "user_id", "original_text")


@query("history_pages_of_all", "O1 O2", _LOG + "SELECT user_id, id, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS k FROM log) WHERE k BETWEEN 11 AND 20")
def history_pages_of_all(spark, sf_dir):
    return h.ranked_pages(log(spark, sf_dir), 2, 10).select("user_id", "id", "rank")


@query("history_totals", "A2", _LOG + "SELECT user_id, count(*) AS total, CAST(ceil(count(*) / 10.0) AS BIGINT) AS pages FROM log GROUP BY user_id")
def history_totals(spark, sf_dir):
    return h.page_totals(log(spark, sf_dir))


@query("history_user_join", "J1", _LOG + "SELECT log.id, usr.name, usr.plan FROM log JOIN usr ON usr.id = log.user_id")
def history_user_join(spark, sf_dir):
    return log(spark, sf_dir).join(users(spark, sf_dir).withColumnRenamed("id", "user_id"), "user_id").select("id", "name", "plan")


@query("history_anonymous_left", "J2", _LOG + "SELECT log.id, log.user_id, usr.name FROM log LEFT JOIN usr ON usr.id = log.user_id")
def history_anonymous_left(spark, sf_dir):
    return log(spark, sf_dir).join(users(spark, sf_dir).select(F.col("id").alias("user_id"), "name"), "user_id", "left").select("id", "user_id", "name")


@query("owned_row", "P6", _LOG + "SELECT id, user_id FROM log WHERE user_id = id % 150")
def owned_row(spark, sf_dir):
    return log(spark, sf_dir).where(F.col("user_id") == F.col("id") % 150).select("id", "user_id")


@query(
    "recent_duplicate", "P7 O3",
    _LOG + "SELECT id, user_id FROM log WHERE user_id = 8 AND translated_text = 'ERROR' AND source_lang = 'en' AND target_lang = 'vi' AND file_path = '' AND created_at >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 2 MINUTES ORDER BY created_at DESC, id DESC LIMIT 1",
)
def recent_duplicate(spark, sf_dir):
    like = {"user_id": 8, "translated_text": "ERROR", "source_lang": "en", "target_lang": "vi", "file_path": ""}
    return h.recent_duplicate(log(spark, sf_dir), like, "2024-01-15 00:00:00").select("id", "user_id")


#: Half of the users are one, so that days reach a quota.
_BUSY = "CASE WHEN user_id % 2 = 0 THEN 0 ELSE user_id END"


@query("quota_by_plan", "A1 P10 P11 J3", _LOG + f", busy AS (SELECT created_at, {_BUSY} AS user_id FROM log WHERE user_id IS NOT NULL) SELECT user_id, CAST(created_at AS DATE) AS day, count(*) AS used, max({_QUOTA}) AS quota, count(*) >= max({_QUOTA}) AS over_quota FROM busy LEFT JOIN usr ON usr.id = busy.user_id GROUP BY user_id, CAST(created_at AS DATE)")
def quota_by_plan(spark, sf_dir):
    return h.quota_decisions(log(spark, sf_dir).where("user_id is not null").withColumn("user_id", F.expr(_BUSY)), users(spark, sf_dir))


@query("usage_percent", "P13", _LOG + "SELECT user_id, count(*) AS used, CAST(least(100, floor(count(*) / 90.0 * 100 + 0.5)) AS INTEGER) AS percent FROM log GROUP BY user_id")
def usage_percent(spark, sf_dir):
    return log(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("used")).withColumn("percent", h.usage_percent(F.col("used"), F.lit(90)))


@query("rejected_requests", "P9", _LOG + "SELECT id, CASE WHEN trim(original_text) = '' THEN 'missing text' WHEN trim(target_lang) = '' THEN 'missing target' END AS rejected FROM log")
def rejected_requests(spark, sf_dir):
    return h.validated(log(spark, sf_dir)).select("id", "rejected")


@query("text_truncate", "P8", "SELECT doc_id, CASE WHEN length(text) > 5000 THEN concat(left(text, 5000), '...') ELSE text END AS stored FROM documents")
def text_truncate(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", h.truncated(F.col("text")).alias("stored"))


@query("preview_100", "P14", "SELECT doc_id, CASE WHEN length(text) > 100 THEN concat(left(text, 100), '...') ELSE text END AS preview FROM documents")
def preview_100(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", h.truncated(F.col("text"), h.PREVIEW_CHARS).alias("preview"))


@query(
    "upload_allowlist", "P12 F52 S2 S8",
    _LOG + r"SELECT id, regexp_extract(file_path, '([^/\\]*)$', 1) AS name, lower(regexp_extract(file_path, '\.([^./\\]+)$', 1)) AS ext, lower(regexp_extract(file_path, '\.([^./\\]+)$', 1)) IN ('pdf', 'docx', 'xlsx', 'txt') AS allowed, lower(regexp_extract(file_path, '\.([^./\\]+)$', 1)) IN ('png', 'jpg', 'jpeg', 'bmp', 'tif', 'tiff', 'webp') AS image FROM log WHERE file_path IS NOT NULL",
)
def upload_allowlist(spark, sf_dir):
    ext = h.extension(F.col("file_path"))
    return log(spark, sf_dir).where("file_path is not null").select("id", h.basename(F.col("file_path")).alias("name"), ext.alias("ext"), ext.isin(*h.UPLOAD_EXTENSIONS).alias("allowed"), ext.isin(*h.IMAGE_EXTENSIONS).alias("image"))


@query("size_gate", "P15", "SELECT event_id, CAST(floor(value * 5000000) AS BIGINT) AS bytes FROM events WHERE CAST(floor(value * 5000000) AS BIGINT) <= 52428800")
def size_gate(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.floor(F.col("value") * 5000000).alias("bytes")).where(F.col("bytes") <= h.MAX_UPLOAD_BYTES)


_FORM = (
    "CASE c_custkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'x' ELSE c_name END AS who",
    "CASE c_custkey % 3 WHEN 0 THEN concat(c_name, '@mail.example') WHEN 1 THEN concat(lower(c_mktsegment), '@x.example') ELSE 'nobody' END AS address",
    "CASE c_custkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'short' WHEN 2 THEN repeat('long ', 300) ELSE 'a message of fair length' END AS body",
)


@query(
    "contact_validation", "P16",
    f"SELECT c_custkey, CASE WHEN trim(who) = '' THEN 'name required' WHEN length(trim(who)) < 2 THEN 'name short' WHEN trim(address) = '' THEN 'email required' WHEN NOT regexp_matches(trim(address), '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'email invalid' WHEN trim(body) = '' THEN 'message required' WHEN length(trim(body)) < 10 THEN 'message short' WHEN length(trim(body)) > 1000 THEN 'message long' END AS error FROM (SELECT c_custkey, {', '.join(_FORM)} FROM customer)",
)
def contact_validation(spark, sf_dir):
    forms = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey", *_FORM)
    return forms.select("c_custkey", h.contact_error(F.col("who"), F.col("address"), F.col("body")).alias("error"))


_AVATAR = "concat('https://img.example/', line, '?', line)"


@query("profile_limits", "P17", _LINES + f"SELECT doc_id, line_no, nullif(trim(line), '') AS name, nullif(trim({_AVATAR}), '') AS avatar, length(trim(line)) <= 255 AND length(trim({_AVATAR})) <= 500 AS accepted FROM ln")
def profile_limits(spark, sf_dir):
    rows = made_lines(spark, sf_dir)
    name, avatar, accepted = h.profile_update(F.col("line"), F.expr(_AVATAR))
    return rows.select("doc_id", "line_no", name.alias("name"), avatar.alias("avatar"), accepted.alias("accepted"))


@query("dashboard_stats", "A16 O9", _LOG + "SELECT count(*) AS shown, count(*) FILTER (CAST(created_at AS DATE) = DATE '2024-01-30') AS today, count(*) FILTER (coalesce(file_path, '') <> '') AS with_file FROM (SELECT * FROM log ORDER BY created_at DESC, id DESC LIMIT 100)")
def dashboard_stats(spark, sf_dir):
    return h.dashboard(log(spark, sf_dir), "2024-01-30")


#: Half of the saves have one key, so that many follow one another within two minutes.
SAVED = ("CASE WHEN user_id % 2 = 0 THEN 0 ELSE user_id % 20 END", "CASE WHEN user_id % 2 = 0 THEN 'same' ELSE event_type END")
_SAVED = ("event_id AS id", f"{SAVED[0]} AS user_id", f"{SAVED[1]} AS original_text", "upper(event_type) AS kind", "'T' AS translated_text", "'en' AS source_lang", "'vi' AS target_lang", "ts AS created_at")
_SAVES = f"SELECT {', '.join(_SAVED)} FROM events"


@query(
    "dedup_recent_save", "ST2",
    f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY user_id, original_text ORDER BY created_at, id) AS k FROM ({_SAVES})),
w AS (SELECT user_id, original_text, k, id, created_at AS last, true AS kept FROM s WHERE k = 1
      UNION ALL
      SELECT s.user_id, s.original_text, s.k, s.id, CASE WHEN s.created_at - w.last > INTERVAL 2 MINUTES THEN s.created_at ELSE w.last END, s.created_at - w.last > INTERVAL 2 MINUTES
      FROM w JOIN s ON s.user_id = w.user_id AND s.original_text = w.original_text AND s.k = w.k + 1)
SELECT id, user_id, original_text FROM w WHERE kept""",
)
def dedup_recent_save(spark, sf_dir):
    saves = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*_SAVED)
    return h.accepted_saves(saves).select("id", "user_id", "original_text")


@query("deleted_users", "K4 J11", _LOG + "SELECT log.id, CASE WHEN log.user_id % 5 = 0 THEN NULL ELSE log.user_id END AS user_id FROM log")
def deleted_users(spark, sf_dir):
    every = users(spark, sf_dir).select("id").unionByName(log(spark, sf_dir).where("user_id is not null").select(F.col("user_id").alias("id")).distinct()).distinct()
    payments = log(spark, sf_dir).select("id", "user_id")
    return h.delete_users(every, log(spark, sf_dir), payments, every.where("id % 5 = 0"))[1].select("id", "user_id")


@query("cascaded_payments", "K4", _LOG + "SELECT id, user_id FROM log WHERE user_id IS NULL OR user_id % 5 <> 0")
def cascaded_payments(spark, sf_dir):
    every = log(spark, sf_dir).where("user_id is not null").select(F.col("user_id").alias("id")).distinct()
    return h.delete_users(every, log(spark, sf_dir), log(spark, sf_dir).select("id", "user_id"), every.where("id % 5 = 0"))[2].select("id", "user_id")
