"""Translation-log analytics: history, quotas, validation, saves."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Quotas a day, limits and allowlists.
QUOTAS = {"free": 170, "pro": 4000, "promax": 10000}
DEFAULT_QUOTA = 170
STORED_CHARS = 5000
PREVIEW_CHARS = 100
MAX_UPLOAD_BYTES = 50 * 1024 * 1024
UPLOAD_EXTENSIONS = ("pdf", "docx", "xlsx", "txt")
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp")
DUPLICATE_MINUTES = 2
DASHBOARD_ROWS = 100

SAVE_KEY = ("user_id", "original_text", "translated_text", "source_lang", "target_lang")


def quota_of(plan: Column) -> Column:
    known = F.create_map(*[x for k, v in QUOTAS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(known[F.lower(F.trim(plan))], F.lit(DEFAULT_QUOTA))


def truncated(text: Column, chars: int = STORED_CHARS) -> Column:
    """The text, or its first ``chars`` characters and three dots."""
    return F.when(F.length(text) > chars, F.concat(F.left(text, F.lit(chars)), F.lit("..."))).otherwise(text)


def blank(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(r"\A[\s ]*\z")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def day_range(column: Column, day: str) -> Column:
    """Rows of one UTC day, as a half-open range that Parquet statistics can prune by.

    ``day`` is year-month-day, with or without leading zeros; another form raises ValueError.
    """
    from datetime import datetime, timedelta

    start = datetime.strptime(day, "%Y-%m-%d")
    return (column >= F.lit(start.isoformat(" ")).cast("timestamp")) & (column < F.lit((start + timedelta(days=1)).isoformat(" ")).cast("timestamp"))


def history(log: DataFrame, user_id: int | None = None, kind: str | None = None, day: str | None = None) -> DataFrame:
    """Rows of the log by owner, by kind ('text' without a file, 'document' with one; any other
    value does not filter) and by day."""
    out = log if user_id is None else log.where(F.col("user_id") == user_id)
    if kind == "text":
        out = out.where(F.col("file_path").isNull())
    elif kind == "document":
        out = out.where(F.col("file_path").isNotNull())
    return out if day is None else out.where(day_range(F.col("created_at"), day))


def shown(log: DataFrame) -> DataFrame:
    """The seven fields a client sees; an empty file path is no file."""
    return log.select(
        "id", "original_text", "translated_text", "source_lang", "target_lang",
        (F.coalesce("file_path", F.lit("")) != "").alias("has_file"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"),
    )


def page(rows: DataFrame, number: int = 1, size: int = 10) -> DataFrame:
    """One page, newest first; ids break ties. A page beyond the end is empty."""
    return rows.orderBy(F.desc("created_at"), F.desc("id")).offset((max(number, 1) - 1) * size).limit(size)


def page_totals(log: DataFrame, size: int = 10) -> DataFrame:
    """Rows and pages of each owner."""
    return log.groupBy("user_id").agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).alias("pages"))


def newest(log: DataFrame, by: str = "user_id") -> DataFrame:
    """The newest row of each owner, by aggregation, so a frequent owner is combined before the shuffle."""
    row = F.struct(*log.columns)
    return log.groupBy(F.col(by).alias("__by")).agg(F.max_by(row, F.struct("created_at", "id")).alias("r")).select("r.*")


def daily_use(log: DataFrame) -> DataFrame:
    return log.groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("used"))


def usage_percent(used: Column, quota: Column) -> Column:
    """Halves round up; a quota of nought or less gives 0."""
    return F.when(quota > 0, F.least(F.lit(100), F.floor(used / quota * 100 + 0.5))).otherwise(0).cast("int")


def quota_decisions(log: DataFrame, users: DataFrame) -> DataFrame:
    """Use of each day against the user's plan; users without a plan have the default quota.

    Users without use that day have no row: none can be over.
    """
    out = daily_use(log).join(users.select(F.col("id").alias("user_id"), "plan"), "user_id", "left")
    return out.select("user_id", "day", "used", quota_of("plan").alias("quota")).withColumn("over_quota", F.col("used") >= F.col("quota"))


def validated(requests: DataFrame) -> DataFrame:
    """Requests with a reason to reject them, or null."""
    reason = F.when(blank(F.col("original_text")), "missing text").when(blank(F.col("target_lang")), "missing target")
    return requests.withColumn("rejected", reason)


def contact_error(name: Column, email: Column, message: Column) -> Column:
    """First fault of a contact form, or null: names of 2 characters at least, an address, 10 to 1000 characters."""
    n, e, m = (F.trim(F.coalesce(c, F.lit(""))) for c in (name, email, message))
    return (
        F.when(n == "", "name required").when(F.length(n) < 2, "name short")
        .when(e == "", "email required").when(~e.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$"), "email invalid")
        .when(m == "", "message required").when(F.length(m) < 10, "message short").when(F.length(m) > 1000, "message long")
    )


def profile_update(name: Column, avatar_url: Column) -> tuple[Column, Column, Column]:
    """(name, avatar, accepted): blank values become null; 255 and 500 characters at most."""
    n, a = F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(avatar_url), F.lit(""))
    return n, a, (F.coalesce(F.length(n), F.lit(0)) <= 255) & (F.coalesce(F.length(a), F.lit(0)) <= 500)


def dashboard(log: DataFrame, day: str, rows: int = DASHBOARD_ROWS) -> DataFrame:
    """Counts over the newest ``rows`` rows: of ``day``, and with a file."""
    few = log.orderBy(F.desc("created_at"), F.desc("id")).limit(rows)
    return few.agg(F.count("*").alias("shown"), F.count_if(F.to_date("created_at") == F.lit(day).cast("date")).alias("today"), F.count_if(F.coalesce("file_path", F.lit("")) != "").alias("with_file"))


def _runs(times: DataFrame, span: int) -> DataFrame:
    """``times`` (k, t, ...) with ``run``: times of a key whose steps are ``span`` at most share one, later runs never depend on it.

    Steps are taken within an hour of a key first and hours are then linked by their first and last
    times, so no window runs over all rows of a key.
    """
    hour = max(3_600_000_000, span)
    cut = times.withColumn("b", F.floor(F.col("t") / hour))
    within = Window.partitionBy("k", "b").orderBy("t")
    step = F.col("t") - F.lag("t").over(within)
    cut = cut.withColumn("new", F.coalesce((step > span).cast("int"), F.lit(1))).withColumn("n", F.sum("new").over(within)).drop("new")
    hours = cut.groupBy("k", "b").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.max("n").alias("runs"))
    along = Window.partitionBy("k").orderBy("b")
    linked = F.coalesce(F.col("first") - F.lag("last").over(along) <= span, F.lit(False))
    name = lambda n: F.struct(F.col("b"), n.cast("long").alias("n"))
    hours = hours.withColumn("linked", linked).withColumn("end", F.last(F.when(F.col("runs") > 1, name(F.col("runs"))).when(~F.col("linked"), name(F.lit(1))), ignorenulls=True).over(along))
    hours = hours.select("k", "b", F.when(F.col("linked"), F.lag("end").over(along)).otherwise(name(F.lit(1))).alias("start"))
    return cut.join(hours, ["k", "b"]).withColumn("run", F.when(F.col("n") == 1, F.col("start")).otherwise(name(F.col("n")))).drop("b", "n", "start")


def accepted_saves(log: DataFrame, key: tuple[str, ...] = SAVE_KEY, minutes: int = DUPLICATE_MINUTES) -> DataFrame:
    """Saves that are stored: a row is dropped when an identical stored row is at most ``minutes`` old.

    Dropped rows are not stored, so they never extend the window; a chain of duplicates is a
    fold and not a comparison with the row before. Texts over the stored length never match
    what is stored of them. Equal times of a key collapse first; its times are cut where a step is longer
    than the window, and what lies between is walked in order as batches pass, with one time in memory.
    """
    stamp = F.unix_micros(F.col("created_at").cast("timestamp"))
    long_text = (F.length("original_text") > STORED_CHARS) | (F.length("translated_text") > STORED_CHARS)
    keyed = log.withColumn("__t", stamp)
    short = keyed.where(~F.coalesce(long_text, F.lit(False)))
    span = minutes * 60_000_000
    firsts = short.groupBy(F.struct(*key).alias("k"), F.col("__t").alias("t")).agg(F.min("id").alias("id"))
    runs = _runs(firsts, span).withColumn("own", F.xxhash64("k", "run"))
    kind = log.schema["id"].dataType.simpleString()

    def walk(batches):
        before, last = None, 0
        for b in batches:
            keep = []
            for own, new, t in zip(b.column("own").to_pylist(), zip(b.column("k").to_pylist(), b.column("run").to_pylist()), b.column("t").to_pylist()):
                here = (own, new)
                kept = here != before or t - last > span
                if kept:
                    before, last = here, t
                keep.append(kept)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(pa.array(keep, pa.bool_()))], names=["id"])

    ordered = runs.repartition("own").sortWithinPartitions("own", "k", "run", "t").select("own", F.to_json("k").alias("k"), F.to_json("run").alias("run"), "t", "id")
    ids = ordered.mapInArrow(walk, f"id {kind}")
    return log.join(ids, "id", "left_semi").unionByName(keyed.where(F.coalesce(long_text, F.lit(False))).drop("__t"))


def recent_duplicate(log: DataFrame, like: dict, now: str, minutes: int = DUPLICATE_MINUTES, collation: str | None = None) -> DataFrame:
    """The newest stored row equal to ``like`` in the last ``minutes``, if any.

    Texts are equal byte for byte, or by a ``collation`` such as ``UNICODE_CI_AI_RTRIM``.
    """
    same = F.lit(True)
    for name, value in like.items():
        column = F.collate(F.col(name), collation) if collation and isinstance(value, str) else F.col(name)
        same = same & column.eqNullSafe(F.lit(value))
    return log.where(same & (F.col("created_at") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {minutes} MINUTES"))).orderBy(F.desc("created_at"), F.desc("id")).limit(1)


def delete_users(users: DataFrame, translations: DataFrame, payments: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Remove the users in ``gone`` (id): their translations stay without an owner, their payments go."""
    ids = gone.select(F.col("id").alias("user_id")).distinct().withColumn("__gone", F.lit(True))
    kept = translations.join(ids, "user_id", "left").withColumn("user_id", F.when(F.col("__gone"), None).otherwise(F.col("user_id"))).select(*translations.columns)
    return users.join(gone.select("id").distinct(), "id", "left_anti"), kept, payments.join(ids, "user_id", "left_anti")


def ranked_pages(log: DataFrame, number: int, size: int) -> DataFrame:
    """That page of every owner at once."""
    order = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    return log.withColumn("rank", F.row_number().over(order)).where(F.col("rank").between((number - 1) * size + 1, number * size))
