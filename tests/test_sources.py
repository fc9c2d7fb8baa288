import io
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from glosspark.operators import history
from glosspark.sources import files, html, office
from glosspark.streaming import logs

LINES = ["Plain & <b>", "tab\there", "", "số ☑"]


def test_docx_round_trip_and_nesting():
    assert [r[4] for r in office.docx_runs(office.write_docx(LINES))] == LINES
    data = office.write_docx(["x"])
    body = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode()
    p = "<w:p><w:r><w:rPr><w:b/></w:rPr><w:t>{}</w:t></w:r></w:p>"
    table = "<w:tbl><w:tr><w:tc>" + p.format("in") + "<w:tbl><w:tr><w:tc>" + p.format("deep") + "</w:tc></w:tr></w:tbl></w:tc></w:tr></w:tbl>"
    header = '<w:hdr xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">' + p.format("head") + "</w:hdr>"
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as old, zipfile.ZipFile(out, "w") as z:
        for i in old.infolist():
            z.writestr(i, old.read(i) if i.filename != "word/document.xml" else body.replace("</w:body>", table + "</w:body>"))
        z.writestr("word/header1.xml", header)
    got = list(office.docx_runs(out.getvalue()))
    assert [(r[0], r[4]) for r in got] == [("body", "x"), ("table", "in"), ("table", "deep"), ("header", "head")]
    assert got[1][5] and len({r[2] for r in got}) == 4


def test_xlsx_round_trip_and_patch():
    rows = [["a", "b & c"], ["", "số"], ["x"] * 30]
    cells = list(office.xlsx_cells(office.write_xlsx(rows)))
    assert [(r, c, v) for _, r, c, v, _ in cells] == [(i, j, v) for i, row in enumerate(rows, 1) for j, v in enumerate(row, 1)]
    new = office.patched_zip(office.write_docx(["x"]), {"word/document.xml": b"y"})
    assert dict(office.zip_members(new))["word/document.xml"] == b"y" and len(list(office.zip_members(new))) == 3


def test_files_by_kind(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("one\n\ntwo", encoding="utf-8")
    (tmp_path / "b.docx").write_bytes(office.write_docx(["p1", "p2"]))
    (tmp_path / "c.xlsx").write_bytes(office.write_xlsx([["cell", " "]]))
    (tmp_path / "d.exe").write_bytes(b"x")
    (tmp_path / "e.docx").write_bytes(b"not a zip")
    got = sorted((r.path.rsplit("/", 1)[1], r.text) for r in files.segments(spark, str(tmp_path)).collect())
    assert got == [("a.TXT", "one"), ("a.TXT", "two"), ("b.docx", "p1"), ("b.docx", "p2"), ("c.xlsx", "cell")]
    assert [(r.path.rsplit("/", 1)[1], r.reason) for r in files.rejected(spark, str(tmp_path)).collect()] == [("d.exe", "unknown kind")]
    files.write_texts(spark.createDataFrame([(1, "x"), (2, "y")], "doc_id int, text string"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_tables(spark):
    files.create_tables(spark, "logs")
    files.create_tables(spark, "logs")
    assert spark.table("logs.translation").columns[:3] == ["id", "user_id", "original_text"]
    spark.sql("INSERT INTO logs.user (id, email) VALUES (1, 'a')")
    assert spark.table("logs.user").first().plan == "free"


def test_html_nodes():
    page = "<p> One &amp; <b>two</b> </p><script>if (a<b) x()</script><pre>keep</pre><!-- c --><br>three"
    assert [(tag, text) for _, tag, text in html.text_nodes(page)] == [("p", " One & "), ("b", "two"), ("", "three")]
    assert html.with_texts(page, ["1 <", None, "3"]) == "<p> 1 &lt; <b>two</b> </p><script>if (a<b) x()</script><pre>keep</pre><!-- c --><br>3"
    assert html.with_texts(page, []) == page and html.text_nodes(None) == []


def log(spark, rows):
    return spark.createDataFrame([(i, u, o, "t", "en", "vi", None, datetime.fromisoformat(at)) for i, u, o, at in rows], "id long, user_id long, original_text string, translated_text string, source_lang string, target_lang string, file_path string, created_at timestamp")


SAVES = [(1, 1, "a", "2024-01-01 00:00:00"), (2, 1, "a", "2024-01-01 00:01:30"), (3, 1, "a", "2024-01-01 00:02:30"), (4, 1, "a", "2024-01-01 00:04:00"), (5, None, "a", "2024-01-01 00:00:10"), (6, 2, "a", "2024-01-01 00:00:00"), (7, 1, "x" * 5001, "2024-01-01 00:00:00"), (8, 1, "x" * 5001, "2024-01-01 00:00:01")]


def test_saves_do_not_extend_the_window(spark):
    kept = sorted(r.id for r in history.accepted_saves(log(spark, SAVES)).collect())
    assert kept == [1, 3, 5, 6, 7, 8]  # long texts never match what is stored of them
    again = history.accepted_saves(history.accepted_saves(log(spark, SAVES)))
    assert sorted(r.id for r in again.collect()) == kept


def test_history_edges(spark):
    rows = log(spark, SAVES)
    assert history.page(rows, 99).collect() == [] and len(history.page(rows, 0, 3).collect()) == 3
    assert history.history(rows, kind="other").count() == 8 and history.history(rows, kind="document").count() == 0
    assert history.history(rows, day="2024-1-1").count() == 8
    with pytest.raises(ValueError):
        history.history(rows, day="yesterday")
    assert [r[0] for r in spark.range(1).select(history.usage_percent(F.lit(1), F.lit(0))).collect()] == [0]


def test_collation_is_an_option(spark):
    rows = log(spark, [(1, 1, "Họ tên ", "2024-01-01 00:00:00")])
    like, now = {"user_id": 1, "original_text": "ho TEN"}, "2024-01-01 00:01:00"
    assert history.recent_duplicate(rows, like, now).collect() == []
    assert [r.id for r in history.recent_duplicate(rows, like, now, collation="UNICODE_CI_AI_RTRIM").collect()] == [1]


def test_day_filter_reaches_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/events.parquet").withColumnRenamed("ts", "created_at")
    plan = history.history(df, day="2024-01-05").select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "props" not in plan.split("ReadSchema")[1]


def test_deleting_users(spark):
    users = spark.createDataFrame([(1,), (2,)], "id long")
    rows = log(spark, SAVES)
    kept, translations, payments = history.delete_users(users, rows, rows.select("id", "user_id"), users.where("id = 1"))
    assert [r.id for r in kept.collect()] == [2]
    assert sorted(str(r.user_id) for r in translations.collect()) == sorted(["None"] * 7 + ["2"])
    assert sorted(str(r.user_id) for r in payments.collect()) == ["2", "None"]


def test_job_state(spark):
    rows = [("a", "2024-01-01 00:00:00", "pending", 0, "m0"), ("a", "2024-01-01 00:00:05", "completed", 130, "m2"), ("a", "2024-01-01 00:00:05", "in_progress", 50, "m1")]
    df = spark.createDataFrame([(j, datetime.fromisoformat(t), s, n, m) for j, t, s, n, m in rows], "job_id string, ts timestamp, status string, progress int, message string")
    assert [tuple(r) for r in logs.job_state(df).collect()] == [("a", "completed", 100, "m2")]


def test_stream_equals_batch_over_several_batches(spark, tmp_path):
    schema = "u long, at timestamp"
    rows = [(i % 3, datetime(2024, 1, 1, 0, i)) for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    kept = logs.run_to_table(logs.exact_saves(stream, ("u",), "at"), f"file://{tmp_path}/out", f"file://{tmp_path}/state").count()
    want, last = 0, {}
    for u, at in rows:
        if u not in last or (at - last[u]).total_seconds() > 120:
            want, last[u] = want + 1, at
    assert kept == want
