"""Document-level steps over made lines, taken as paragraphs and runs."""

from pyspark.sql import functions as F

from glosspark.functions import fonts, languages
from glosspark.operators import documents as d
from glosspark.plans.segments import _CORE, _LINES, made_lines
from glosspark.registry import query


@query("languages", "J3", "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in languages.LANGUAGES.items()) + ") t(code, name)")
def language_table(spark, sf_dir):
    return languages.languages(spark)


_CODES = "CASE doc_id % 5 WHEN 0 THEN lang WHEN 1 THEN 'ZH-tw' WHEN 2 THEN ' VI ' WHEN 3 THEN 'iw' ELSE 'xx' END"


@query("prompt_languages", "F49 X4", f"SELECT doc_id, CASE lower(trim(c)) WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' WHEN 'es' THEN 'Spanish' WHEN 'zh-tw' THEN 'Chinese (Traditional)' WHEN 'vi' THEN 'Vietnamese' WHEN 'iw' THEN 'Hebrew' ELSE c END AS name, lower(trim(c)) = 'vi' AS vietnamese FROM (SELECT doc_id, {_CODES} AS c FROM documents)")
def prompt_languages(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", f"{_CODES} AS c")
    return rows.select("doc_id", languages.prompt_name(F.col("c")).alias("name"), languages.vietnamese_target(F.col("c")).alias("vietnamese"))


@query("font_names", "F47", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'timesnewroman' WHEN 1 THEN 'helvetica' WHEN 2 THEN 'wingdings' WHEN 3 THEN 'couriernew' ELSE 'odd' END AS name, CASE event_id % 5 WHEN 0 THEN 'timesnewroman' WHEN 1 THEN 'arial' WHEN 3 THEN 'courier' END AS family, event_id % 5 = 2 AS symbol FROM events")
def font_names(spark, sf_dir):
    font = F.element_at(F.array(*[F.lit(x) for x in ("TimesNewRomanPS-BoldMT", "Helvetica-Oblique", "Wingdings", "Courier New,Bold", "Odd!")]), (F.col("event_id") % 5 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", fonts.plain_name(font).alias("name"), fonts.family(font).alias("family"), fonts.symbol_font(font).alias("symbol"))


@query("strategies", "D1 D3", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'inline_blocks' WHEN doc_id % 3 = 1 AND doc_id % 5 <> 0 THEN 'blocks' WHEN doc_id % 3 = 2 AND doc_id % 7 <> 0 THEN 'bilingual_docx' WHEN doc_id % 11 <> 0 THEN 'layout' ELSE 'redact' END AS strategy FROM documents")
def strategies(spark, sf_dir):
    mode = F.element_at(F.array(F.lit("inline"), F.lit("none"), F.lit("newline")), (F.col("doc_id") % 3 + 1).cast("int"))
    i = F.col("doc_id")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", d.strategy(mode, i % 2 == 0, i % 5 != 0, F.lit(False), i % 7 != 0, i % 11 != 0, F.lit(True)).alias("strategy"))


_PART = "CASE line_no % 4 WHEN 0 THEN 'footer' WHEN 1 THEN 'body' WHEN 2 THEN 'table' ELSE 'header' END"


@query("document_parts", "U1 U4 S5b", _LINES + f"SELECT doc_id, line_no, {_PART} AS part, CASE line_no % 4 WHEN 0 THEN 4 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS part_order FROM ln")
def document_parts(spark, sf_dir):
    rows = made_lines(spark, sf_dir).selectExpr("doc_id", "line_no", f"{_PART} AS part")
    return d.in_parts(*[rows.where(F.col("part") == p) for p in d.PART_ORDER])


@query("seen_once", "J13 U3", _LINES + "SELECT doc_id, element, line_no FROM (SELECT doc_id, line, line AS element, line_no, row_number() OVER (PARTITION BY doc_id, line ORDER BY line_no) AS k FROM ln) WHERE k = 1")
def seen_once(spark, sf_dir):
    return d.seen_once(made_lines(spark, sf_dir).withColumnRenamed("line", "element"), "element", "line_no").select("doc_id", "element", "line_no")


@query("replaceable_images", "S12 J11 J12", _LINES + "SELECT DISTINCT doc_id AS path, line_no % 6 AS member FROM ln WHERE line_no % 6 <> 0 AND line_no % 6 <> 5 AND line_no % 5 <> 0 AND (doc_id, line_no % 6) NOT IN (SELECT doc_id, line_no % 6 FROM ln WHERE line_no % 5 = 0)")
def replaceable_images(spark, sf_dir):
    rows = made_lines(spark, sf_dir).select(F.col("doc_id").alias("path"), (F.col("line_no") % 6).alias("member"), (F.col("line_no") % 5 == 0).alias("protected"))
    return d.replaceable_images(rows, rows.where("member in (0, 5)")).select("path", "member")


@query("image_counts", "A11", _LINES + "SELECT doc_id, count(*) AS found, count(*) FILTER (line_no % 3 <> 0) AS attempted, count(*) FILTER (line_no % 3 = 1) AS replaced, count(*) FILTER (line_no % 3 = 0) AS skipped FROM ln GROUP BY doc_id")
def image_counts(spark, sf_dir):
    return d.image_counts(made_lines(spark, sf_dir).withColumns({"attempted": F.col("line_no") % 3 != 0, "replaced": F.col("line_no") % 3 == 1}))


_PARA = "WITH pa AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN replace(text, chr(10), ' ') ELSE concat(replace(text, chr(10), ' '), chr(10), ' ') END AS text FROM documents)\n"


def paragraphs(spark, sf_dir):
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    text = F.when(F.col("doc_id") % 3 == 0, F.col("text")).when(F.col("doc_id") % 3 == 1, flat).otherwise(F.concat(flat, F.lit("\n "))).alias("text")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", text)


@query("breaks_repaired", "D11", _PARA + r"SELECT doc_id, 0 AS half, CASE WHEN instr(text, chr(10)) > 0 AND regexp_matches(substring(text, instr(text, chr(10)) + 1), '\S') THEN substring(text, 1, instr(text, chr(10)) - 1) ELSE text END AS text FROM pa UNION ALL SELECT doc_id, 1, regexp_replace(substring(text, instr(text, chr(10)) + 1), '^\s+|\s+$', '', 'g') FROM pa WHERE instr(text, chr(10)) > 0 AND regexp_matches(substring(text, instr(text, chr(10)) + 1), '\S')")
def breaks_repaired(spark, sf_dir):
    return d.break_repaired(paragraphs(spark, sf_dir))


@query("suspicious_paragraphs", "D12", _PARA + r"SELECT doc_id, CASE WHEN length(replace(text, chr(10), '\n')) > 240 THEN left(replace(text, chr(10), '\n'), 240) || '…' ELSE replace(text, chr(10), '\n') END AS shown FROM pa WHERE contains(text, '→') OR contains(text, chr(10))")
def suspicious_paragraphs(spark, sf_dir):
    return d.suspicious(paragraphs(spark, sf_dir)).select("doc_id", "shown")


@query("paragraph_spacing", "D12", _LINES + f"SELECT doc_id, line_no, contains(line, chr(9)) AS has_tab, contains(line, '  ') AS multi_space FROM ln WHERE {_CORE} <> ''")
def paragraph_spacing(spark, sf_dir):
    return d.spacing(made_lines(spark, sf_dir), "line").select("doc_id", "line_no", "has_tab", "multi_space")


@query("paragraph_pairs", "D6", _LINES + "SELECT doc_id, line_no AS para_no, half, CASE WHEN half = 0 THEN line ELSE 'x' END AS text FROM ln, (VALUES (0), (1)) h(half) WHERE half = 0 OR line_no % 2 = 0")
def paragraph_pairs(spark, sf_dir):
    rows = made_lines(spark, sf_dir).select("doc_id", F.col("line_no").alias("para_no"), F.col("line").alias("text"), F.when(F.col("line_no") % 2 == 0, "x").otherwise(" ").alias("translated"))
    return d.with_translations_after(rows)


@query("applied_to_runs", "D5", _LINES + r", r AS (SELECT doc_id, CAST(line_no // 4 AS INTEGER) AS para_no, line_no AS run_no, line AS text, line_no % 9 = 0 AS dr, NOT regexp_matches(line, '[\pL\pN_\x{C0}-\x{1EF9}]') AS st FROM ln), f AS (SELECT *, min(run_no) FILTER (NOT dr AND NOT st) OVER (PARTITION BY doc_id, para_no) AS first FROM r) SELECT doc_id, para_no, run_no, CASE WHEN dr OR st OR para_no % 2 = 1 THEN text WHEN run_no = first THEN 'done' ELSE '' END AS text FROM f")
def applied_to_runs(spark, sf_dir):
    runs = made_lines(spark, sf_dir).select("doc_id", (F.col("line_no") / 4).cast("int").alias("para_no"), F.col("line_no").alias("run_no"), F.col("line").alias("text"), (F.col("line_no") % 9 == 0).alias("has_drawing"))
    done = runs.where("para_no % 2 = 0").select("doc_id", "para_no", F.lit("done").alias("translated")).distinct()
    return d.applied_to_runs(runs, done).select("doc_id", "para_no", "run_no", "text")


@query("toc_and_headings", "F57", "SELECT doc_id, doc_id % 3 = 0 OR doc_id % 4 = 0 AS toc, doc_id % 3 = 1 AS heading FROM documents")
def toc_and_headings(spark, sf_dir):
    style = F.element_at(F.array(F.lit("TOC 1"), F.lit("Heading 2"), F.lit("Normal")), (F.col("doc_id") % 3 + 1).cast("int"))
    field = F.when(F.col("doc_id") % 4 == 0, ' TOC \\o "1-3" ')
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", d.toc(style, field).alias("toc"), d.heading(style).alias("heading"))
