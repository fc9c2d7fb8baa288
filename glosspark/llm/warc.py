"""Not-modified revisits resolved to the full response they stand for.

An as-of join by canonical URL: each revisit takes the latest full response captured strictly
before it (of equal times the larger record id). It resolves if a validator that both have is
equal (entity tag, compared weakly, else last-modified time); permitted headers of the revisit
then replace the stored ones. Everything is DataFrame code.

Shape: times are grouped first, so any number of captures of one URL at one time is one row;
times are cut into ``buckets`` ranges with about as many captures each, so a range has few of any URL,
in a burst too; the last response of each earlier range is
carried in, and a window runs within a range only. Payloads are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that describe the stored payload; a not-modified answer never replaces them.
FIXED_HEADERS = ("content-encoding", "content-length", "content-range", "content-type", "transfer-encoding")
BUCKETS = 1_024
#: A range has its share of all captures and two of this many parts of them, at most.
ACCURACY = 10_000


def canonical_url(url: Column) -> Column:
    """Host lower-cased without ``www.`` or default port, no scheme, fragment, or slash at the path's end; a query as it is."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "(?s)#.*$", ""), "(?i)^https?://(www[.])?", "")
    host, path, asked = (F.regexp_extract(bare, "(?s)^([^/?]*)([^?]*)(.*)$", k) for k in (1, 2, 3))
    return F.concat(F.regexp_replace(F.lower(host), ":(80|443)$", ""), F.regexp_replace(path, "/+$", ""), asked)


def _tag(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def _range_of(ts: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are at most ``ts``, found by every 32nd first."""
    if not cuts:
        return F.lit(0)
    few = F.size(F.filter(F.lit(cuts[31::32]), lambda c: c <= ts)) if len(cuts) > 31 else F.lit(0)
    return few * 32 + F.size(F.filter(F.slice(F.lit(cuts), few * 32 + 1, F.lit(32)), lambda c: c <= ts))


def resolve_revisits(records: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Resolve ``revisit`` rows of (record_id, url, ts bigint, kind 'response'|'revisit', etag,
    last_modified, headers map<string,string> with lower-case names).

    One row per revisit: record_id, url (canonical), ts, base_id (the response, null if none is
    earlier), status, headers (merged; the revisit's own if unresolved). status: 'resolved';
    'mismatch' if a validator both have differs; 'unchecked' if they share none; 'orphan' if there
    is no earlier response. Rows with a null url, ts or kind: revisits are orphans, responses
    are ignored. Equal rows each get a row. Columns of other names are ignored.
    """
    rows = records.select("record_id", canonical_url(F.col("url")).alias("url"), "ts", "kind", "etag", "last_modified", "headers")
    full = rows.where("kind = 'response' and url is not null and ts is not null")
    asked = rows.where("kind = 'revisit'")
    # one row for each URL and time: the best response of that time, if any
    kept = F.struct("record_id", "etag", "last_modified", "headers")
    best = full.groupBy("url", "ts").agg(F.max_by(kept, "record_id").alias("r"))
    times = best.select("url", "ts", "r").unionByName(asked.where("url is not null and ts is not null").select("url", "ts", F.lit(None).cast(best.schema["r"].dataType).alias("r")))
    times = times.groupBy("url", "ts").agg(F.max_by("r", F.col("r").isNotNull()).alias("r"))
    cuts = rows.agg(F.percentile_approx("ts", [k / buckets for k in range(1, buckets)], F.lit(ACCURACY))).first()[0] if buckets > 1 else None
    placed = times.withColumn("b", _range_of(F.col("ts"), sorted(set(cuts or ()))))
    ends_of = placed.where("r is not null").groupBy("url", "b").agg(F.max_by("r", "ts").alias("e"))
    carried = placed.select("url", "b").distinct().join(ends_of, ["url", "b"], "left")
    earlier = Window.partitionBy("url").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("url", "b", F.last("e", ignorenulls=True).over(earlier).alias("carry"))
    within = Window.partitionBy("url", "b").orderBy("ts").rowsBetween(Window.unboundedPreceding, -1)
    seen = placed.withColumn("p", F.last("r", ignorenulls=True).over(within)).join(carried, ["url", "b"]).select("url", "ts", F.coalesce("p", "carry").alias("base"))
    placeless = F.col("url").isNull() | F.col("ts").isNull()
    alone = asked.where(placeless).withColumn("base", F.lit(None).cast(best.schema["r"].dataType))  # orphans, not dealt out by their null key
    out = asked.where(~placeless).join(seen, ["url", "ts"], "left").select(*asked.columns, "base").unionByName(alone)
    by_tag = _tag(F.col("etag")) == _tag(F.col("base.etag"))
    checked = F.coalesce(by_tag, F.col("last_modified") == F.col("base.last_modified"))
    status = F.when(F.col("base.record_id").isNull(), "orphan").when(checked, "resolved").when(~checked, "mismatch").otherwise("unchecked")
    own = F.coalesce("headers", F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>")))
    fresh = F.map_filter(own, lambda k, v: ~k.isin(*FIXED_HEADERS) & v.isNotNull())
    stored = F.map_filter(F.coalesce("base.headers", F.map_from_entries(F.array().cast("array<struct<k:string,v:string>>"))), lambda k, v: ~F.array_contains(F.map_keys(fresh), k))
    return out.withColumn("status", status).select("record_id", "url", "ts", F.col("base.record_id").alias("base_id"), "status", F.when(F.col("status") == "resolved", F.map_concat(stored, fresh)).otherwise(F.col("headers")).alias("headers"))


def captures_of(pages: DataFrame) -> DataFrame:
    """WARC-like records made from ``pages``, which has neither times nor validators.

    Each page is a full response at time 10 * page_id with its html's MD5 as entity tag, then a
    revisit 50,000 later with that tag, a new date and expiry, and a content type that must not
    be merged. The stored response has a content type and a length.
    """
    tag = F.md5(F.col("html").cast("binary"))
    full = pages.select(
        (F.col("page_id") * 2).alias("record_id"), "url", (F.col("page_id") * 10).alias("ts"), F.lit("response").alias("kind"), tag.alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), F.octet_length("html").cast("string"), F.lit("date"), (F.col("page_id") * 10).cast("string")).alias("headers"),
    )
    again = pages.select(
        (F.col("page_id") * 2 + 1).alias("record_id"), "url", (F.col("page_id") * 10 + 50_000).alias("ts"), F.lit("revisit").alias("kind"), F.concat(F.lit("W/"), tag).alias("etag"), F.lit(None).cast("string").alias("last_modified"),
        F.create_map(F.lit("content-type"), F.lit("text/plain"), F.lit("date"), (F.col("page_id") * 10 + 50_000).cast("string"), F.lit("expires"), (F.col("page_id") * 10 + 60_000).cast("string")).alias("headers"),
    )
    return full.unionByName(again)
