"""Translation of made lines through the stub provider, masking, documents in and out."""

from pyspark.sql import functions as F

from glosspark.functions import patterns as p
from glosspark.functions import text as t
from glosspark.operators import layout as lay
from glosspark.operators import masking, ocr, segments, sequential as seq, translate as tr
from glosspark.plans.layout import _CLASS, _OCR_LINES, _PAGES, boxes, words
from glosspark.plans.segments import _CELL, _CORE, _LINES, _NONSEM, _case, _q, made_lines, strip_sql
from glosspark.registry import query
from glosspark.sources import files, html, office

_WANTED = f"{_CORE} <> '' AND len(regexp_extract_all({_CORE}, '\\pL')) >= 2"
_PREFIX = f"regexp_extract(line, {_q(p.LIST_PREFIX_TEXT)}, 1)"
_BODY = f"substring(line, length({_PREFIX}) + 1)"
_SAID = f"CASE WHEN NOT ({_WANTED}) OR {_NONSEM} OR NOT regexp_matches({_BODY}, '[A-Za-zÀ-ỹ]') THEN line ELSE {_PREFIX} || rtrim('[VI] ' || {_BODY}) END"


@query("segment_dictionary", "J8 A11", _LINES + f"SELECT {_CORE} AS core, count(*) AS uses FROM ln WHERE {_WANTED} AND NOT {_NONSEM} GROUP BY {_CORE}")
def segment_dictionary(spark, sf_dir):
    return tr.segment_dictionary(made_lines(spark, sf_dir), "line")


@query("translated_segments", "J8 X1 X2 F13 D2", _LINES + f"SELECT doc_id, line_no, {_SAID} AS translated FROM ln")
def translated_segments(spark, sf_dir):
    return tr.translated(made_lines(spark, sf_dir), "line", "vi").select("doc_id", "line_no", "translated")


@query("translated_cells", "F22 D7 J3", _LINES + f"SELECT doc_id, line_no, CASE WHEN regexp_matches(lower({_CORE}), '^(not|no)\\s*null$') THEN 'Not NULL' WHEN {_case(p.CONSTRAINT_TEXT)} IS NOT NULL THEN {_case(p.CONSTRAINT_TEXT)} ELSE {_SAID.replace(_NONSEM, _CELL)} END AS translated FROM ln")
def translated_cells(spark, sf_dir):
    return tr.translated(made_lines(spark, sf_dir), "line", "vi", in_table=True).select("doc_id", "line_no", "translated")


@query("bilingual_newline", "D6 X6 F26", _LINES + f"SELECT doc_id, line_no, CASE WHEN {_CORE} = {strip_sql(_SAID)} THEN line ELSE line || chr(10) || {_SAID} END AS output FROM ln")
def bilingual_newline(spark, sf_dir):
    return tr.joined(tr.translated(made_lines(spark, sf_dir), "line", "vi"), "line", "line_by_line").select("doc_id", "line_no", "output")


@query("bilingual_adjacent", "D2 F26", _LINES + f"SELECT doc_id, line_no, CASE WHEN {_CORE} = {strip_sql(_SAID)} THEN {_CORE} ELSE {_CORE} || ' | ' || {strip_sql(_SAID)} END AS output FROM ln")
def bilingual_adjacent(spark, sf_dir):
    return tr.joined(tr.translated(made_lines(spark, sf_dir), "line", "vi"), "line", "inline").select("doc_id", "line_no", "output")


@query("translated_documents", "D8 A9 K1", _LINES + f"SELECT doc_id, string_agg({_SAID}, chr(10) ORDER BY line_no) AS text FROM ln GROUP BY doc_id")
def translated_documents(spark, sf_dir):
    done = tr.translated(made_lines(spark, sf_dir), "line", "vi")
    return segments.rejoined(done.select("doc_id", "line_no", F.col("translated").alias("text")), "doc_id", "line_no", "text", "\n")


@query("provider_cascade", "X3 X8", _LINES + f"SELECT core AS text, coalesce({_case(p.GLOSSARY).replace(_CORE, 'core')}, '[VI] ' || core) AS answer FROM (SELECT DISTINCT {_CORE} AS core FROM ln) WHERE core <> ''")
def provider_cascade(spark, sf_dir):
    cores = made_lines(spark, sf_dir).select(t.strip(F.col("line")).alias("text")).where("text <> ''")
    return tr.answers(cores, "vi", ask=tr.cascade("glossary", "stub"))


def _hesitant():
    """A provider whose first answer to any request is that it timed out."""
    asked = set()

    def call(texts, source, target, context):
        if tuple(texts) not in asked:
            asked.add(tuple(texts))
            raise TimeoutError("timed out")
        return tr.stub(texts, source, target, context)

    return call


@query("retried_answers", "ST5 X2", _LINES + f"SELECT DISTINCT {_CORE} AS text, '[VI] ' || {_CORE} AS answer FROM ln WHERE {_CORE} <> ''")
def retried_answers(spark, sf_dir):
    cores = made_lines(spark, sf_dir).select(t.strip(F.col("line")).alias("text")).where("text <> ''")
    return tr.answers(cores, "vi", ask=tr.retrying(_hesitant(), wait=lambda seconds: None))


# Each pass numbers its matches in what the one before left, so each is one more subquery.
_MASKED = _LINES + ", m0 AS (SELECT doc_id, line_no, line, line AS text, 0 AS n, CAST(NULL AS VARCHAR) AS without FROM ln)"
for _k, (_kind, _pattern, _fold) in enumerate(p.MASK_STEPS):
    _x = _q(("(?i)" if _fold else "") + _pattern.replace("-", r"\x{E000}-\x{F8FF}"))
    _MASKED += f""",
m{_k + 1} AS (SELECT doc_id, line_no, line, array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || CASE WHEN i < len(parts) THEN '[[{_kind}' || printf('%03d', n + i) || ']]' ELSE '' END), '') AS text, n + len(parts) - 1 AS n,
  CASE WHEN n = 0 AND len(parts) > 1 THEN regexp_replace(line, {_x}, '') ELSE without END AS without FROM (SELECT *, regexp_split_to_array(text, {_x}) AS parts FROM m{_k}))"""
_LAST = f"m{len(p.MASK_STEPS)}"


@query(
    "mask_roundtrip", "F10 F11 F12",
    _MASKED + f" SELECT doc_id, line_no, CASE line_no % 3 WHEN 0 THEN line WHEN 1 THEN coalesce(without, line) ELSE line || ' [[ID999]]' END AS restored, line_no % 3 = 1 AND n > 0 AS lost, line_no % 3 = 2 AS leaked FROM {_LAST}",
)
def mask_roundtrip(spark, sf_dir):
    """Answers as they should be, without their first token, and with a token that was never sent."""
    rows = made_lines(spark, sf_dir).withColumn("m", masking.mask(F.col("line")))
    short = F.regexp_replace("m.masked", r"\[\[(CODE|ID|SYM|GLY)001\]\]", "")
    said = F.when(F.col("line_no") % 3 == 0, F.col("m.masked")).when(F.col("line_no") % 3 == 1, short).otherwise(F.concat("m.masked", F.lit(" [[ID999]]")))
    back = rows.withColumn("said", said).withColumn("restored", masking.unmask(F.col("said"), F.col("m.tokens")))
    return back.select("doc_id", "line_no", "restored", masking.lost(F.col("said"), F.col("m.tokens")).alias("lost"), masking.leaked(F.col("restored")).alias("leaked"))


@query("masked_lines", "F10", _MASKED + f" SELECT doc_id, line_no, text AS masked, CAST(n AS INTEGER) AS n_tokens FROM {_LAST}")
def masked_lines(spark, sf_dir):
    rows = made_lines(spark, sf_dir).withColumn("m", masking.mask(F.col("line")))
    return rows.select("doc_id", "line_no", "m.masked", F.size("m.tokens").alias("n_tokens"))


@query("folded_lines", "F27 F46", _LINES + "SELECT doc_id, line_no, regexp_replace(lower(strip_accents(line)), '[^a-z0-9]+', '', 'g') AS folded FROM ln")
def folded_lines(spark, sf_dir):
    return made_lines(spark, sf_dir).select("doc_id", "line_no", tr.folded(F.col("line")).alias("folded"))


@query("echo_free", "F28 F29", _LINES + f"SELECT doc_id, line_no, 'done' AS answer FROM ln WHERE length(regexp_replace(lower(strip_accents({_CORE})), '[^a-z0-9]+', '', 'g')) > 0 AND NOT contains(line, '|')")
def echo_free(spark, sf_dir):
    rows = made_lines(spark, sf_dir).where((F.length(tr.folded(F.col("line"))) > 0) & ~F.contains("line", F.lit("|")))
    return rows.select("doc_id", "line_no", tr.echo_free(F.col("line"), F.concat(t.strip(F.col("line")), F.lit(" | done"))).alias("answer"))


def _cut(kind, pattern):
    body, marks = f"regexp_split_to_array(line, '{pattern}')", f"regexp_extract_all(line, '{pattern}')"
    return f"""SELECT doc_id, page_no, seq, layout_type, generate_subscripts({body}, 1) * 2 - 2 AS n, unnest({body}) AS text, false AS kept FROM r WHERE layout_type = '{kind}'
  UNION ALL SELECT doc_id, page_no, seq, layout_type, generate_subscripts({marks}, 1) * 2 - 1, unnest({marks}), true FROM r WHERE layout_type = '{kind}'"""


_ITEM = f"regexp_extract(line, {_q(p.LIST_PREFIX_PDF)}, 1)"


_PARTS = (
    _CLASS + f""", pt AS ({_cut('dotted_placeholder', p.LEADER_PDF)}
  UNION ALL {_cut('form_field', p.FORM_SPLIT)}
  UNION ALL SELECT doc_id, page_no, seq, layout_type, 0, {_ITEM}, true FROM r WHERE layout_type = 'list_item'
  UNION ALL SELECT doc_id, page_no, seq, layout_type, 1, substring(line, length({_ITEM}) + 1), false FROM r WHERE layout_type = 'list_item'
  UNION ALL SELECT doc_id, page_no, seq, layout_type, 0, line, layout_type IN ('page_number', 'whitespace') FROM r WHERE layout_type NOT IN ('dotted_placeholder', 'form_field', 'list_item')),
dp AS (SELECT doc_id, page_no, seq, layout_type, CAST(n AS INTEGER) AS part_no, text, NOT kept AND {_WANTED.replace('line', 'text')} AS ask FROM pt)"""
)


@query("dispatched_parts", "D4", _PARTS + " SELECT * FROM dp")
def dispatched_parts(spark, sf_dir):
    return tr.by_type(lay.classified(boxes(spark, sf_dir))).select("doc_id", "page_no", "seq", "layout_type", "part_no", "text", "ask")


_SECRET = "a secret of some length"
_INNER, _OUTER = ("".join(f"\\x{b ^ pad:02X}" for b in _SECRET.encode().ljust(64, b"\0")) for pad in (0x36, 0x5C))


@query("signed_rows", "F50", f"SELECT event_id, sha256('{_OUTER}'::BLOB || unhex(sha256('{_INNER}'::BLOB || encode('amount=' || event_id || '&user=' || coalesce(CAST(user_id AS VARCHAR), 'None'))))) AS signature FROM events")
def signed_rows(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", tr.signed({"user": F.col("user_id"), "amount": F.col("event_id")}, _SECRET).alias("signature"))


@query("html_text_nodes", "S7 D9")
def html_text_nodes(spark, sf_dir):
    return html.html_nodes(spark.read.parquet(f"{sf_dir}/pages.parquet"))


_NODE = r"regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<(script|style|code|pre|noscript)\b.*?</(script|style|code|pre|noscript)>', '<x>', 'g'), '>([^<]+)', 1)"
for _name, _char in (("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&lt", "<"), ("&gt", ">"), ("&amp;", "&"), ("&amp", "&")):  # titles are cut off, so the last may lack its end
    _NODE = f"list_transform({_NODE}, lambda x: replace(x, '{_name}', '{_char}'))"


@query(
    "html_roundtrip", "S7 D9",
    rf"""WITH n AS (SELECT page_id, list_filter({_NODE}, lambda x: regexp_matches(x, '[^\s\x{{A0}}]')) AS ts FROM pages)
SELECT page_id, CAST(generate_subscripts(ts, 1) - 1 AS INTEGER) AS seq, regexp_replace(unnest(ts), '(?s)^([\s\x{{A0}}]*)(.*?)([\s\x{{A0}}]*)$', '\1[\2]\3') AS text FROM n""",
)
def html_roundtrip(spark, sf_dir):
    """Text nodes of pages whose text nodes were put in brackets."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("nodes", html.nodes("html"))
    said = F.transform("nodes", lambda n: F.concat(F.lit("["), t.strip(n.text), F.lit("]")))
    again = pages.select("page_id", html.nodes(html.rebuilt("html", said)).alias("again"))
    return again.select("page_id", F.explode("again").alias("n")).select("page_id", "n.seq", "n.text")


@query("html_plain", "F51", r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<br\s*/?>|</(p|div|li|h[1-6]|tr)>', chr(10), 'gi'), '(?s)<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS text FROM pages""")
def html_plain(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", html.plain_text(F.col("html")).alias("text"))


def _office(spark, sf_dir, column):
    rows = made_lines(spark, sf_dir)
    packed = segments.rejoined(rows, "doc_id", "line_no", "line", "\n")
    return packed.select(F.concat(F.lit("in/"), F.col("doc_id").cast("string")).alias("path"), column(F.split("line", "\n", -1)).alias("content"))


@query("docx_paragraphs", "S5 S5b U1 A9 K1", _LINES + "SELECT doc_id, line_no AS para_no, line AS text FROM ln")
def docx_paragraphs(spark, sf_dir):
    runs = office.read_docx(_office(spark, sf_dir, office.docx_of))
    return runs.groupBy("path", "para_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_no", "text"))), lambda x: x.text), "").alias("text")).select(F.substring("path", 4, 20).cast("bigint").alias("doc_id"), "para_no", "text")


@query("xlsx_cells", "S4 D7 K1", _LINES + f"SELECT doc_id, CAST(line_no + 1 AS INTEGER) AS \"row\", 1 AS col, line AS value FROM ln WHERE {_CORE} <> ''")
def xlsx_cells(spark, sf_dir):
    cells = office.read_xlsx(_office(spark, sf_dir, office.xlsx_of)).where((F.col("data_type") == "s") & (t.strip(F.col("value")) != ""))
    return cells.select(F.substring("path", 4, 20).cast("bigint").alias("doc_id"), "row", "col", "value")


@query("patched_members", "K2", "SELECT doc_id, member, CASE WHEN member = 'word/document.xml' THEN 3 ELSE -1 END AS size FROM (SELECT doc_id, unnest(['[Content_Types].xml', '_rels/.rels', 'word/document.xml']) AS member FROM documents)")
def patched_members(spark, sf_dir):
    members = office.read_members(_office(spark, sf_dir, office.docx_of))
    new = members.where("member = 'word/document.xml'").select("path", "member", F.lit("new").cast("binary").alias("data"))
    out = office.patch_members(members, new)
    return out.select(F.substring("path", 4, 20).cast("bigint").alias("doc_id"), "member", F.when(F.length("data") == 3, 3).otherwise(-1).alias("size"))


@query("docx_fallback", "K3", "SELECT 'in/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.txt' ELSE '.docx' END AS path, doc_id % 3 <> 0 AS word FROM documents")
def docx_fallback(spark, sf_dir):
    made = _office(spark, sf_dir, office.docx_of).withColumn("path", F.concat("path", F.lit(".docx")))
    broken = F.substring("path", 4, 20).substr(F.lit(1), F.length("path") - 8).cast("bigint") % 3 == 0
    rows = made.withColumn("content", F.when(broken, F.lit("gone").cast("binary")).otherwise(F.col("content")))
    out = office.with_fallback(rows, rows.select("path", F.lit("text").alias("text")))
    return out.select("path", office.valid_docx("content").alias("word"))


_PAGE = "concat('{\"blocks\":[{\"type\":0,\"lines\":[{\"bbox\":[1.5,2,30,4],\"spans\":[{\"text\":\"ab\",\"font\":\"Arial-BoldMT\",\"size\":9,\"flags\":0,\"color\":5},{\"text\":\"cde', CAST(doc_id AS VARCHAR(20)), '\",\"font\":\"Arial\",\"size\":', CAST(doc_id % 9 + 4 AS VARCHAR(20)), ',\"flags\":2,\"color\":7}]}]},{\"type\":1}]}')"


@query("pdf_page_lines", "S6 A7 A8 A9", "SELECT doc_id, 0 AS seq, 'abcde' || doc_id AS line, CAST(doc_id % 9 + 4 AS DOUBLE) AS font_size, 7 AS color, true AS is_bold, true AS is_italic, CAST(1.5 AS DOUBLE) AS x0 FROM documents")
def pdf_page_lines(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", "1 AS page_no", f"{_PAGE} AS page")
    return files.page_lines(pages).select("doc_id", "seq", "line", "font_size", "color", "is_bold", "is_italic", "x0")


def _pages(name, ops, fold, sql=None):
    @query(name, ops, sql)
    def run(spark, sf_dir):
        return seq.per_page(lay.classified(boxes(spark, sf_dir)), fold)


_ROWS = _PAGES.replace("WITH ", "WITH RECURSIVE ", 1) + """, b AS (SELECT *, (y0 + y1) / 2 AS mid, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY seq) AS k FROM bx),
f AS (SELECT doc_id, page_no, k, mid AS base, 1 AS run FROM b WHERE k = 1
  UNION ALL SELECT b.doc_id, b.page_no, b.k, CASE WHEN abs(b.mid - f.base) > 4.5 THEN b.mid ELSE f.base END, CASE WHEN abs(b.mid - f.base) > 4.5 THEN f.run + 1 ELSE f.run END
  FROM f JOIN b ON b.doc_id = f.doc_id AND b.page_no = f.page_no AND b.k = f.k + 1)
SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY run, x0, y0, seq) - 1 AS INTEGER) AS seq, line AS text, x0, y0, x1, y1, [CAST(seq AS INTEGER)] AS members FROM b JOIN f USING (doc_id, page_no, k)"""
_pages("rows_reordered", "W5", seq.reordered, _ROWS)


_FLOW = """WITH RECURSIVE b AS (SELECT doc_id, page_no, seq, y0, y1, CASE WHEN seq % 4 = 0 THEN 18.0 ELSE 0.0 END AS extra, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY seq) AS k FROM bx),
f AS (SELECT doc_id, page_no, k, seq, CAST(0 AS DOUBLE) AS shift, extra, y1 FROM b WHERE k = 1
  UNION ALL SELECT b.doc_id, b.page_no, b.k, b.seq, greatest(0.0, f.shift + f.extra - least(f.shift + f.extra, greatest(0.0, b.y0 - f.y1) * 0.85)), b.extra, b.y1 FROM f JOIN b ON b.doc_id = f.doc_id AND b.page_no = f.page_no AND b.k = f.k + 1)
"""


@query("page_flow", "W12", "WITH RECURSIVE " + _PAGES.removeprefix("WITH ").rstrip() + ", " + _FLOW.removeprefix("WITH RECURSIVE ") + "SELECT doc_id, page_no, seq, round(shift, 6) AS shift FROM f")
def page_flow(spark, sf_dir):
    rows = boxes(spark, sf_dir).withColumn("extra", F.when(F.col("seq") % 4 == 0, 18.0).otherwise(0.0))
    return seq.flow(rows).withColumn("shift", F.round("shift", 6))


_WRAP = "list_reduce({w}, lambda a, w: CASE WHEN length(regexp_extract(a, '[^\\n]*$')) + 1 + length(w) <= {n} THEN a || ' ' || w ELSE a || chr(10) || w END)"


def _wrap_sql(text, n):
    words = f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"
    return f"CASE WHEN len({words}) = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split({_WRAP.format(w=words, n=n)}, chr(10)) END"


@query(
    "overflow_pages", "W13",
    _PAGES.replace("WITH ", "WITH RECURSIVE ", 1) + f""", it AS (SELECT doc_id, CAST(page_no * 30 + seq AS INTEGER) AS item, font_size AS fs, font_size * 1.2 AS lh, len({_wrap_sql('line', 60)}) AS n FROM bx),
l AS (SELECT doc_id, item, fs, lh, unnest(range(0, CAST(n AS BIGINT))) AS line_no FROM it),
o AS (SELECT *, row_number() OVER w AS k, lag(lh) OVER w AS plh FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY item, line_no)),
f AS (SELECT doc_id, k, item, line_no, 1 AS page, CAST(42.0 AS DOUBLE) AS y FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.k, o.item, o.line_no,
    CASE WHEN f.y + o.plh + (CASE WHEN o.line_no = 0 THEN o.plh * 0.4 ELSE 0 END) + o.fs > 836 THEN f.page + 1 ELSE f.page END,
    CASE WHEN f.y + o.plh + (CASE WHEN o.line_no = 0 THEN o.plh * 0.4 ELSE 0 END) + o.fs > 836 THEN 42.0 ELSE f.y + o.plh + (CASE WHEN o.line_no = 0 THEN o.plh * 0.4 ELSE 0 END) END
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.k = f.k + 1)
SELECT doc_id, item, CAST(line_no AS INTEGER) AS line_no, page, round(y, 6) AS y FROM f""",
)
def overflow_pages(spark, sf_dir):
    items = boxes(spark, sf_dir).select("doc_id", (F.col("page_no") * 30 + F.col("seq")).cast("int").alias("item"), F.col("font_size"), (F.col("font_size") * 1.2).alias("line_h"), F.size(seq.wrapped(F.col("line"), F.lit(60))).alias("n_lines"))
    return seq.overflow_pages(items).withColumn("y", F.round("y", 6))


_HARD = "flatten(list_transform(list_filter(regexp_split_to_array(line, '\\s+'), lambda w: w <> ''), lambda w: list_transform(range(0, CAST(ceil(length(w) / 8.0) AS BIGINT)), lambda i: CASE WHEN i > 0 THEN chr(1) ELSE '' END || substring(w, i * 8 + 1, 8))))"


@query(
    "wrapped_lines", "W14",
    _LINES + f"""SELECT doc_id, line_no, {_wrap_sql('line', 40)} AS soft, CASE WHEN len({_HARD}) = 0 THEN CAST([] AS VARCHAR[]) ELSE string_split(list_reduce({_HARD}, lambda a, w: CASE WHEN NOT starts_with(w, chr(1)) AND length(regexp_extract(a, '[^\\n]*$')) + 1 + length(w) <= 8 THEN a || ' ' || w ELSE a || chr(10) || replace(w, chr(1), '') END), chr(10)) END AS hard FROM ln""",
)
def wrapped_lines(spark, sf_dir):
    return made_lines(spark, sf_dir).select("doc_id", "line_no", seq.wrapped(F.col("line"), F.lit(40)).alias("soft"), seq.wrapped_hard(F.col("line"), F.lit(8)).alias("hard"))


_TWICE = "replace(line, 'e', 'E')"


@query(
    "wrapped_bilingual", "W14",
    _LINES + f"""SELECT doc_id, line_no, CASE WHEN {_CORE} = '' OR length({_CORE}) + 2 < 60 THEN CASE WHEN {_CORE} = '' THEN CAST([] AS VARCHAR[]) ELSE {_wrap_sql(f"({_CORE} || ' | ' || {strip_sql(_TWICE)})", 60)} END ELSE list_concat({_wrap_sql(f"({_CORE} || ' |')", 60)}, {_wrap_sql(_TWICE, 60)}) END AS lines FROM ln""",
)
def wrapped_bilingual(spark, sf_dir):
    return made_lines(spark, sf_dir).select("doc_id", "line_no", seq.bilingual_lines(F.col("line"), F.replace("line", F.lit("e"), F.lit("E")), F.lit(60)).alias("lines"))


@query(
    "merged_anchors", "W17",
    _PAGES.replace("WITH ", "WITH RECURSIVE ", 1) + """, a AS (SELECT x.doc_id, x.page_no, x.seq, x.y1, coalesce(min(y.y0) FILTER (y.y0 >= x.y1 - 1), 842.0) AS anchor FROM bx x JOIN bx y USING (doc_id, page_no) GROUP BY x.doc_id, x.page_no, x.seq, x.y1),
n AS (SELECT doc_id, page_no, anchor, 30.0 - (anchor - y1) AS extra, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY anchor, 30.0 - (anchor - y1)) AS k FROM a WHERE 30.0 - (anchor - y1) > 0),
f AS (SELECT doc_id, page_no, k, anchor AS base, extra FROM n WHERE k = 1
  UNION ALL SELECT n.doc_id, n.page_no, n.k, CASE WHEN abs(f.base - n.anchor) < 5 THEN f.base ELSE n.anchor END, n.extra FROM f JOIN n ON n.doc_id = f.doc_id AND n.page_no = f.page_no AND n.k = f.k + 1)
SELECT doc_id, page_no, base AS y, max(extra) AS extra FROM f GROUP BY doc_id, page_no, base""",
)
def merged_anchors(spark, sf_dir):
    return seq.merged_anchors(lay.insertion_needs(boxes(spark, sf_dir), F.lit(30.0)))


@query("distributed_spans", "F44", _LINES + "SELECT doc_id, line_no, line AS whole, CAST(least(3, greatest(length(line), 1)) AS INTEGER) AS n FROM ln")
def distributed_spans(spark, sf_dir):
    rows = made_lines(spark, sf_dir)
    n = F.least(F.lit(3), F.greatest(F.length("line"), F.lit(1)))
    cut = seq.distribute(F.transform(F.sequence(F.lit(1), n), lambda i: F.repeat(F.lit("x"), i * 5)), F.col("line"))
    return rows.withColumn("parts", cut).select("doc_id", "line_no", F.array_join("parts", "").alias("whole"), F.size("parts").alias("n"))


@query("dot_filled", "F45", _LINES + "SELECT doc_id, line_no, substring(line, 1, 5) || repeat('.', greatest(3, 40 - 2 * length(substring(line, 1, 5)))) || substring(line, 1, 5) AS filled FROM ln")
def dot_filled(spark, sf_dir):
    a = F.substring("line", 1, 5)
    return made_lines(spark, sf_dir).select("doc_id", "line_no", seq.filled(F.array(a, a), F.lit(40)).alias("filled"))


_OCR = "list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(regexp_replace(x, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')), lambda x: length(x) > 1 OR regexp_matches(x, '[0-9]'))"


@query(
    "reflowed_prose", "F38",
    f"SELECT doc_id, CASE WHEN len({_OCR}) = 0 THEN '' ELSE list_reduce({_OCR}, lambda a, x: a || CASE WHEN regexp_matches(a, '[.!?:;]$') OR regexp_matches(x, '^(-|\\*|[0-9]+[.)])\\s+') THEN chr(10) ELSE ' ' END || x) END AS prose FROM documents",
)
def reflowed_prose(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", t.reflowed(F.col("text")).alias("prose"))


@query(
    "run_groups", "W10 U4",
    _LINES + f""", k AS (SELECT doc_id, line_no, last_value(CASE WHEN {_CORE} = '' THEN NULL WHEN NOT regexp_matches(line, '[\\pL\\pN_\\x{{C0}}-\\x{{1EF9}}]') THEN 'alone:' || line_no ELSE 'f' || (line_no // 3) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS key FROM ln),
c AS (SELECT doc_id, line_no, coalesce(key, '') AS key, lag(coalesce(key, '')) OVER (PARTITION BY doc_id ORDER BY line_no) AS before FROM k)
SELECT doc_id, line_no AS run_no, CAST(sum(CASE WHEN before = key THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS group_no FROM c""",
)
def run_groups(spark, sf_dir):
    runs = made_lines(spark, sf_dir).select("doc_id", F.lit(0).alias("para_no"), F.col("line_no").alias("run_no"), F.col("line").alias("text"), F.concat(F.lit("f"), (F.col("line_no") / 3).cast("int").cast("string")).alias("fmt_key"))
    return lay.run_groups(runs).select("doc_id", "run_no", "group_no")


@query(
    "logical_lines", "W11",
    _LINES + """, r AS (SELECT doc_id, line_no, CASE line_no % 6 WHEN 5 THEN chr(10) WHEN 2 THEN chr(9) ELSE line END AS text FROM ln),
e AS (SELECT doc_id, line_no, text = chr(10) OR (text = chr(9) AND regexp_matches(coalesce(lead(text) OVER (PARTITION BY doc_id ORDER BY line_no), ''), '^\\s*([0-9]+[.)]|\\p{Lu}{2,})')) AS ends FROM r)
SELECT doc_id, line_no AS run_no, CAST(coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_no FROM e""",
)
def logical_lines(spark, sf_dir):
    text = F.when(F.col("line_no") % 6 == 5, "\n").when(F.col("line_no") % 6 == 2, "\t").otherwise(F.col("line"))
    runs = made_lines(spark, sf_dir).select("doc_id", F.lit(0).alias("para_no"), F.col("line_no").alias("run_no"), text.alias("text"))
    return lay.logical_lines(runs).select("doc_id", "run_no", "line_no")


@query("overlay_blocks", "D10 X5", _OCR_LINES + f""", o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY top, "left", text) - 1 AS seq FROM ol),
t AS (SELECT image_id, seq, "left", text AS line FROM o)
SELECT image_id, CAST(seq AS INTEGER) AS seq, "left" / 400.0 AS x, {_SAID} AS translated_text FROM t WHERE NOT regexp_matches(line, '\\.{{5,}}|_{{4,}}|-{{4,}}')""")
def overlay_blocks(spark, sf_dir):
    out = ocr.overlay_blocks(ocr.words_to_lines(words(spark, sf_dir)), 400.0, 400.0, "vi")
    return out.where(~F.col("original_text").rlike(p.LEADER_IMAGE)).select("image_id", "seq", F.col("position.bbox_norm")[0].alias("x"), "translated_text")
