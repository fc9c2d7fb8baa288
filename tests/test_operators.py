"""Operators called directly, against plain loops and values worked out by hand."""

import hashlib
import hmac
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from glosspark.functions import text as t
from glosspark.operators import documents, history, ocr, segments, sequential, translate
from glosspark.sources import files
from glosspark.streaming import logs

START = datetime(2024, 1, 1)


def accepted(rows, minutes=2):
    """Ids stored of (id, key, time) rows."""
    kept, last = [], {}
    for t_, i, key in sorted((t_, i, key) for i, key, t_ in rows):
        if key not in last or t_ - last[key] > timedelta(minutes=minutes):
            kept.append(i)
            last[key] = t_
    return sorted(kept)


def saves(spark, rows):
    df = spark.createDataFrame([(i, k, at) for i, k, at in rows], "id long, user_id long, created_at timestamp")
    return df.selectExpr("id", "user_id", "'a' AS original_text", "'t' AS translated_text", "'en' AS source_lang", "CAST(NULL AS STRING) AS target_lang", "created_at")


def test_saves_by_a_loop(spark):
    rng = random.Random(4)
    rows, at = [], START
    for i in range(1500):
        at += timedelta(seconds=rng.choice([0, 1, 30, 60, 119, 120, 121, 300, 4000]))
        rows.append((i, rng.choice([1, 1, 1, 2, None]), at))
    as_key = [(i, -1 if k is None else k, a) for i, k, a in rows]
    assert sorted(r.id for r in history.accepted_saves(saves(spark, rows)).collect()) == accepted(as_key)
    assert history.accepted_saves(saves(spark, rows).limit(0)).collect() == []


def test_saves_of_one_hot_key(spark):
    n = 100_000
    df = spark.range(n).selectExpr("id", "7L AS user_id", "'a' AS original_text", "'t' AS translated_text", "'en' AS source_lang", "'vi' AS target_lang", "timestamp_seconds(1704067200 + id * 7) AS created_at")
    want = accepted([(i, 7, START + timedelta(seconds=7 * i)) for i in range(n)])
    assert sorted(r.id for r in history.accepted_saves(df).select("id").collect()) == want


def test_runs_cross_hours_once(spark):
    rng = random.Random(1)
    times = sorted({rng.randrange(0, 40_000_000_000) for _ in range(400)})
    span = 120_000_000
    df = spark.createDataFrame([("k", x, i) for i, x in enumerate(times)], "k string, t long, id long")
    got = sorted(((r.t, tuple(r.run)) for r in history._runs(df, span).collect()))
    for (a, x), (b, y) in zip(got, got[1:]):
        assert (x == y) == (b - a <= span)


def test_stream_forgets_keys_and_stays_exact(spark, tmp_path):
    rows = [(i % 2, START + timedelta(seconds=50 * i)) for i in range(200)]
    for k in range(5):
        spark.createDataFrame(rows[k * 40 : k * 40 + 40], "u long, at timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u long, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = logs.run_to_table(logs.exact_saves(stream, ("u",), "at"), f"file://{tmp_path}/out", f"file://{tmp_path}/state").count()
    assert kept == len(accepted([(i, u, at) for i, (u, at) in enumerate(rows)]))


def test_stream_of_saves(spark, tmp_path):
    rows = [(1, START), (1, START + timedelta(seconds=10)), (2, START), (1, START + timedelta(minutes=30))]
    spark.createDataFrame(rows, "u long, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("u long, at timestamp").parquet(str(tmp_path / "in"))
    got = logs.run_to_table(logs.saves(stream, key=("u",), at="at"), f"file://{tmp_path}/out", f"file://{tmp_path}/state", mode="append")
    assert sorted({r.u for r in got.collect()}) == [1, 2] and got.count() <= 3


def test_signatures(spark):
    row = spark.createDataFrame([(3, None)], "amount long, user long")
    got = row.select(translate.signed({"user": F.col("user"), "amount": F.col("amount")}, "k").alias("s")).first().s
    assert got == hmac.new(b"k", b"amount=3&user=None", hashlib.sha256).hexdigest()


def test_dispatch_by_type(spark):
    rows = [("dotted_placeholder", "Name ...... Class"), ("form_field", "Name : Lan"), ("list_item", "1. first point"), ("page_number", "12"), ("whitespace", " "), ("title", "A title"), ("paragraph", "x")]
    df = spark.createDataFrame(rows, "layout_type string, line string")
    got = {(r.layout_type, r.part_no): (r.text, r.ask) for r in translate.by_type(df).collect()}
    assert got["dotted_placeholder", 1][1] is False and got["dotted_placeholder", 2] == (" Class", True)
    assert got["list_item", 0][1] is False and got["list_item", 1] == ("first point", True)
    assert got["page_number", 0] == ("12", False) and got["whitespace", 0] == (" ", False) and got["title", 0] == ("A title", True) and got["paragraph", 0] == ("x", False)
    assert any(k == "form_field" and ask for (k, _), (_, ask) in got.items())


@pytest.mark.parametrize(
    ("form", "error"),
    [((" ", "a@b.c", "ten letters"), "name required"), (("x", "a@b.c", "ten letters"), "name short"), (("xy", None, "ten letters"), "email required"), (("xy", "a@b", "ten letters"), "email invalid"), (("xy", "a@b.c", ""), "message required"), (("xy", "a@b.c", "short"), "message short"), (("xy", "a@b.c", "x" * 1001), "message long"), (("xy", "a@b.c", "ten letters"), None)],
)
def test_contact_errors(spark, form, error):
    df = spark.createDataFrame([form], "a string, b string, c string")
    assert df.select(history.contact_error(F.col("a"), F.col("b"), F.col("c"))).first()[0] == error


def test_token_budgets(spark):
    cases = [(10, "document", 64), (5000, "document", 2048), (None, "document", 900), (10, "document_pdf_run_batch", 3072), (9999, "document_pdf_run_batch", 4096), (10, "document_pdf_adjacent_inline", 2048)]
    df = spark.createDataFrame(cases, "n int, c string, want int")
    assert all(r[0] == r[1] for r in df.select(t.token_budget(F.col("n"), F.col("c")), "want").collect())


def test_vision_lines(spark):
    said = 'so: {"lines":[{"text":" a ","bbox":[-1,0.1,0.5,0.2]},{"text":"","bbox":[0,0,1,0.1]},{"text":"tall","bbox":[0,0,1,0.9]},{"text":"b","bbox":[0,0,1]},{"text":"back","bbox":[0.5,0,0.4,0.1]}]}'
    got = spark.createDataFrame([(said,), ("none",)], "x string").select(t.vision_lines(F.col("x")).alias("v")).collect()
    assert [(x.text, x.bbox) for x in got[0].v] == [("a", [0.0, 0.1, 0.5, 0.2])] and not got[1].v


def test_overlay_blocks(spark):
    lines = spark.createDataFrame([(1, 10, 20, 110, 40, 90.0, "Hello there"), (1, 10, 60, 110, 80, 90.0, "....... .....")], "image_id long, left int, top int, right int, bottom int, mean_conf double, text string")
    got = sorted(ocr.overlay_blocks(lines, 200.0, 100.0, "vi").collect(), key=lambda r: r.seq)
    assert got[0].translated_text == "[VI] Hello there" and list(got[0].position.bbox_norm) == [0.05, 0.2, 0.55, 0.4]


def test_strategies(spark):
    cases = [("inline", True, True, "inline_blocks"), ("inline", False, True, "layout"), ("none", True, True, "blocks"), ("newline", True, False, "redact")]
    df = spark.createDataFrame(cases, "m string, first boolean, layout boolean, want string")
    own = F.col("first")
    got = df.select(documents.strategy(F.col("m"), own, own, F.lit(False), F.lit(False), F.col("layout"), F.lit(True)).alias("s"), "want").collect()
    assert all(r.s == r.want for r in got)


def test_batches_have_tags_of_three_digits(spark):
    rows = spark.range(1200).selectExpr("1 AS doc_id", "CAST(id AS INT) AS line_no", "concat('x', id) AS line")
    sent = segments.packed_batches(segments.numbered_batches(rows, 999, "line_no"), "line")
    back = segments.parsed_batches(sent)
    assert back.count() == 1200 and back.where("batch_no = 0").agg(F.max("row_no")).first()[0] == 999
    with pytest.raises(ValueError):
        segments.numbered_batches(rows, 1000, "line_no")


def test_labels_and_open_ends():
    for text, label in [("Title: x", True), ("TV1: Ho ten: abc", True), ("Tom tat [a: b]", False), ("at 10:30", False), ("see http://x", False), ("abc: x", False), ("Goals:", True), ("(string: x) then", False), ("ends 5: x", False)]:
        assert sequential.label_line(text) == label, text
    for text, both in [("goes on", (True, True)), ("ends.", (False, True)), ("wait...", (True, True)), ("(a) b)", (False, True)), ("(all of it)", (False, False)), ("(one (two)", (False, True)), ("why?", (False, False)), ("", (False, False)), (" . ", (False, False)), ("(a) b (c)", (False, True)), ("(a); (c)", (False, False))]:
        assert (sequential.goes_on(text), sequential.goes_on_typed(text)) == both, text


def test_log_rows_of_a_database(spark):
    url, how = "jdbc:derby:memory:logs;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(100).selectExpr("id", "id % 3 AS user_id").write.jdbc(url, "payment", mode="overwrite", properties=how)
    rows = files.log_rows(spark, url, "payment", (0, 100), 4, **how)
    assert rows.rdd.getNumPartitions() == 4
    mine = history.history(rows, 1)
    assert mine.count() == 33 and "PushedFilters: [*IsNotNull(user_id), *EqualTo(user_id,1)]" in mine._jdf.queryExecution().executedPlan().toString()


def test_luminance_of_a_half_is_rounded_as_in_sql(spark, tmp_path):
    """Colours whose luminance is 128 but for rounding."""
    import duckdb

    from glosspark import registry
    from glosspark.plans import load_all

    load_all()
    colours = [(12, 175, 4), (29, 165, 53), (46, 155, 102), (80, 135, 200), (111, 138, 79), (128, 128, 128)]
    ids = [((r << 16) + (g << 8) + b) * pow(7919, -1, 1 << 24) % (1 << 24) for r, g, b in colours]
    ids = [i + (1 << 24) * (i % 9 == 0) for i in ids]
    spark.createDataFrame([(i,) for i in ids], "event_id long").write.parquet(f"{tmp_path}/events.parquet")
    want = duckdb.execute(registry.ORACLE_SQL["span_colours"].replace("FROM events", f"FROM '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    got = registry.QUERIES["span_colours"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert {r.event_id: r.dark for r in got} == dict(zip(ids, (True, False, True, True, True, False)))
