import random

from glosspark.llm import warc

SCHEMA = "record_id bigint, url string, ts bigint, kind string, etag string, last_modified string, headers map<string,string>"


def canonical(u):
    path, mark, asked = u.lower().split("#")[0].replace("https://", "").replace("http://", "").removeprefix("www.").partition("?")
    return path.rstrip("/") + mark + asked


def brute(rows):
    out = []
    for i, u, t, k, tag, lm, h in rows:
        if k != "revisit":
            continue
        earlier = [r for r in rows if r[3] == "response" and u and t is not None and r[1] and r[2] is not None and canonical(r[1]) == canonical(u) and r[2] < t]
        if not earlier:
            out.append((i, None, "orphan", h))
            continue
        b = max(earlier, key=lambda r: (r[2], r[0]))
        strong = lambda x: x.removeprefix("W/")
        if tag is not None and b[4] is not None:
            ok = strong(tag) == strong(b[4])
        elif lm is not None and b[5] is not None:
            ok = lm == b[5]
        else:
            out.append((i, b[0], "unchecked", h))
            continue
        fresh = {k: v for k, v in (h or {}).items() if k not in warc.FIXED_HEADERS and v is not None}
        out.append((i, b[0], "resolved", {**(b[6] or {}), **fresh}) if ok else (i, b[0], "mismatch", h))
    return sorted(out, key=str)


def captures(seed=0, n=300):
    rng = random.Random(seed)
    urls = ["http://a.example/x", "https://www.A.example/x/", "http://a.example/x#top", "http://b.example/", "http://c.example/y?q=1", "http://c.example/y/?q=1", "http://c.example/y?q=1/", "http://d.example/y\nz?a", None]
    rows = []
    for i in range(n):
        h = rng.choice([None, {}, {"date": str(i), "content-type": "t", "expires": None}, {"etag": "e", "vary": "v"}])
        rows.append((i, rng.choice(urls), rng.choice([None, *range(40)]), rng.choice(["response", "revisit", "revisit", None]), rng.choice([None, "1", "W/1", "2"]), rng.choice([None, "m", "n"]), h))
    return rows


def test_against_brute_force(spark):
    rows = captures()
    rows = [r for r in rows] + [rows[5]] * 2
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS base", "'x' AS status", "1 AS b")
    for buckets in (1, 7, 1024):
        got = warc.resolve_revisits(df, buckets).collect()
        assert sorted(((r.record_id, r.base_id, r.status, r.headers) for r in got), key=str) == brute(rows)


def test_one_hot_url(spark):
    rows = [(i, "http://a.example/", i // 3, "response" if i % 5 == 0 else "revisit", str(i % 2), None, None) for i in range(600)]
    got = warc.resolve_revisits(spark.createDataFrame(rows, SCHEMA), 16).collect()
    assert sorted(((r.record_id, r.base_id, r.status, r.headers) for r in got), key=str) == brute(rows)


def test_empty(spark):
    assert warc.resolve_revisits(spark.createDataFrame([], SCHEMA)).collect() == []


def test_canonical_urls(spark):
    rows = [("HTTP://WWW.A.example:80/X/#t", "a.example/X"), ("https://a.example/?next=/", "a.example?next=/"), ("https://a.example?next=", "a.example?next="), ("a.example//", "a.example"), ("http://b.example:443/p/?", "b.example/p?"), (None, None)]
    got = spark.createDataFrame(rows, "u string, want string").select(warc.canonical_url(warc.F.col("u")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got), got


def test_rows_without_a_place_are_not_joined(spark):
    df = spark.range(20_000).selectExpr("id AS record_id", "CAST(NULL AS STRING) AS url", "id AS ts", "'revisit' AS kind", "'t' AS etag", "CAST(NULL AS STRING) AS last_modified", "CAST(NULL AS MAP<STRING, STRING>) AS headers")
    got = warc.resolve_revisits(df)
    assert got.where("status = 'orphan'").count() == 20_000


def test_ranges_by_their_cuts(spark):
    rng = random.Random(2)
    for n in (0, 1, 5, 31, 32, 33, 64, 200):
        cuts = sorted(rng.sample(range(1000), n))
        df = spark.range(-1, 1001).select("id", warc._range_of(warc.F.col("id"), cuts).alias("b"))
        assert all(r.b == sum(c <= r.id for c in cuts) for r in df.collect())


def test_a_burst_at_one_url_is_cut(spark):
    df = spark.range(30_000).selectExpr("id AS record_id", "if(id % 3 = 0, 'hot.example', concat('u', id, '.example')) AS url", "if(id % 3 = 0, 1000000 + id, id * 1000000) AS ts", "if(id % 2 = 0, 'response', 'revisit') AS kind", "'t' AS etag", "CAST(NULL AS STRING) AS last_modified", "CAST(NULL AS MAP<STRING, STRING>) AS headers")
    got = warc.resolve_revisits(df, 64)
    assert got.where("url = 'hot.example' and status = 'resolved' and base_id = record_id - 3").count() == 5_000
    cuts = sorted(set(df.agg(warc.F.percentile_approx("ts", [k / 64 for k in range(1, 64)], warc.F.lit(warc.ACCURACY))).first()[0]))
    most = df.groupBy("url", warc._range_of(warc.F.col("ts"), cuts)).count().agg({"count": "max"}).first()[0]
    assert most <= 30_000 / 64 + 2 * 30_000 / warc.ACCURACY + 1
