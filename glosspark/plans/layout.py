"""Page layout and recognised text. Boxes are made from line numbers and lengths by formulas that
both engines read alike: on every third page three columns with a break between two tables, else one."""

from pyspark.sql import functions as F

from glosspark.functions import geometry as g
from glosspark.functions import patterns as p
from glosspark.functions import text as t
from glosspark.operators import layout as lay
from glosspark.operators import ocr
from glosspark.plans.segments import _LINES, _q, made_lines, strip_sql
from glosspark.registry import query

_COLUMNS, _BREAK = "(doc_id + CAST(floor(line_no / 30) AS INT)) % 3 = 1", "line_no % 30 BETWEEN 12 AND 17"
_GEOMETRY = {
    "doc_id": "doc_id",
    "page_no": "CAST(floor(line_no / 30) AS INT)",
    "seq": "line_no % 30",
    "line": "line",
    "font_size": "CAST(9 + (line_no * 7) % 5 + CASE WHEN line_no % 17 = 0 THEN 8 ELSE 0 END AS DOUBLE)",
    "is_bold": "line_no % 4 = 0",
    "is_italic": "line_no % 5 = 0",
    "is_table_cell": "line_no % 8 IN (2, 3, 4)",
    "x0": f"CAST(72 + CASE WHEN {_COLUMNS} AND NOT {_BREAK} THEN 160 * (line_no % 3) ELSE (line_no * 37) % 6 * 22 END AS DOUBLE)",
    "y0": f"CAST(20 + CASE WHEN {_COLUMNS} THEN 27 * floor((line_no % 30) / 3) + line_no % 3 * CASE WHEN {_BREAK} THEN 9 ELSE 1 END ELSE 27 * (line_no % 30) END AS DOUBLE)",
}
_EDGES = {"x1": "x0 + 5.5 * least(length(line), 24 + line_no % 40)", "y1": "y0 + font_size * 1.2"}


def _sql(columns):
    return ", ".join(f"{v} AS {k}" for k, v in columns.items())


_PAGES = _LINES + f", g AS (SELECT line_no, {_sql(_GEOMETRY)} FROM ln), bx AS (SELECT *, {_sql(_EDGES)} FROM g)\n"


def boxes(spark, sf_dir):
    rows = made_lines(spark, sf_dir).selectExpr("line_no", *[f"{v} AS {k}" for k, v in _GEOMETRY.items()])
    return rows.selectExpr("*", *[f"{v} AS {k}" for k, v in _EDGES.items()])


KEY = ("doc_id", "page_no", "seq")


@query("line_spacing", "W1", _PAGES + "SELECT doc_id, page_no, seq, coalesce(y0 - lag(y1) OVER (PARTITION BY doc_id, page_no ORDER BY seq), 0.0) AS spacing FROM bx")
def line_spacing(spark, sf_dir):
    return lay.line_spacing(boxes(spark, sf_dir)).select(*KEY, F.col("line_spacing").alias("spacing"))


@query("reading_order", "O4 S6", _PAGES + "SELECT doc_id, page_no, line, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY round_even(y0 / 3, 0) * 3, x0, seq) - 1 AS INTEGER) AS seq FROM bx")
def reading_order(spark, sf_dir):
    return lay.reading_order(boxes(spark, sf_dir)).select("doc_id", "page_no", "line", "seq")


@query("page_stats", "A4 A5 A15", _PAGES + "SELECT doc_id, page_no, list_sort(list(font_size))[len(list(font_size)) // 2 + 1] AS median_size, list_sort(list(x0))[len(list(x0)) // 4 + 1] AS typical_x0, max(x1) AS text_right FROM bx GROUP BY doc_id, page_no")
def page_stats(spark, sf_dir):
    return lay.page_stats(boxes(spark, sf_dir))


_C = strip_sql("line")
_FORM = _q("(?i)" + p.FORM_FIELD)
_ALIGN = "CASE WHEN abs((x0 + x1) / 2 - 595 / 2.0) < 595 * 0.05 AND x0 > 595 * 0.15 THEN 'center' WHEN 595 - x1 < 595 * 0.08 AND x0 > 595 * 0.3 THEN 'right' ELSE 'left' END"
_CLASS = _PAGES + f""", st AS (SELECT doc_id, page_no, list_sort(list(font_size))[len(list(font_size)) // 2 + 1] AS m, list_sort(list(x0))[len(list(x0)) // 4 + 1] AS tx FROM bx GROUP BY doc_id, page_no),
c AS (SELECT bx.*, m, tx, {_C} AS core, {_ALIGN} AS al FROM bx JOIN st USING (doc_id, page_no)),
k AS (SELECT *, length(core) AS n, length(core) - length(replace(core, ':', '')) AS colons FROM c),
r AS (SELECT *, CASE WHEN core = '' THEN 'whitespace'
 WHEN regexp_matches(line, '{p.PAGE_NUMBER}') AND (y0 < 842 * 0.08 OR y1 > 842 * 0.92) THEN 'page_number'
 WHEN y0 < 842 * 0.06 OR y1 > 842 * 0.94 THEN 'header_footer'
 WHEN regexp_matches(line, '{p.LEADER_PDF}') THEN CASE WHEN regexp_matches(line, {_FORM}) THEN 'form_field' ELSE 'dotted_placeholder' END
 WHEN regexp_matches(line, {_FORM}) AND ((colons >= 2 AND n <= 320) OR (colons >= 1 AND n <= 120) OR n < 60) THEN 'form_field'
 WHEN regexp_matches(line, {_q(p.LIST_LAYOUT)}) THEN 'list_item'
 WHEN (font_size > m * 1.3 AND is_bold) OR font_size > m * 1.5 OR (is_bold AND al = 'center' AND n < 80) OR (al = 'center' AND font_size > m * 1.2 AND n < 100) THEN 'title'
 WHEN font_size < m * 0.85 AND is_italic AND n < 120 THEN 'caption' ELSE 'paragraph' END AS layout_type FROM k)
"""


@query(
    "line_class", "F16 F17 F18 A8",
    _CLASS + "SELECT doc_id, page_no, seq, layout_type, CASE WHEN layout_type = 'whitespace' THEN 'left' ELSE al END AS alignment, CASE WHEN layout_type IN ('whitespace', 'page_number', 'header_footer', 'title') THEN 0 WHEN x0 > tx + 15 THEN greatest(1, CAST(floor((x0 - tx) / 20) AS INTEGER)) ELSE 0 END AS indent_level FROM r",
)
def line_class(spark, sf_dir):
    return lay.classified(boxes(spark, sf_dir)).select(*KEY, "layout_type", "alignment", "indent_level")


_ROWS = """, m AS (SELECT *, (y0 + y1) / 2 AS mid, lag((y0 + y1) / 2) OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, seq) AS pm FROM bx),
rw AS (SELECT *, sum(CASE WHEN pm IS NULL OR pm < 0 OR abs(mid - pm) < 8 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, seq ROWS UNBOUNDED PRECEDING) AS row_no FROM m)
"""
_REGIONS = _ROWS + """, rr AS (SELECT doc_id, page_no, row_no, count(*) AS n, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM rw GROUP BY doc_id, page_no, row_no),
ri AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, page_no) AS blocks, row_no - sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS island FROM rr),
rg AS (SELECT doc_id, page_no, min(row_no) AS first, min(x0) AS x0, arg_min(y0, row_no) AS y0, max(x1) AS x1, arg_max(y1, row_no) AS y1 FROM ri WHERE n >= 2 AND blocks >= 3 GROUP BY doc_id, page_no, island HAVING count(*) >= 2),
reg AS (SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY first) AS INTEGER) AS region_no, x0, y0, x1, y1 FROM rg)
"""


@query("row_clusters", "W2", _PAGES + _ROWS + "SELECT doc_id, page_no, seq, CAST(row_no AS BIGINT) AS row_no FROM rw")
def row_clusters(spark, sf_dir):
    return lay.row_clusters(boxes(spark, sf_dir)).select(*KEY, "row_no")


@query("table_regions", "W3 A6", _PAGES + _REGIONS + "SELECT * FROM reg")
def table_regions(spark, sf_dir):
    return lay.table_regions(boxes(spark, sf_dir))


@query("table_membership", "J4", _PAGES + _REGIONS + "SELECT bx.doc_id, bx.page_no, bx.seq, min(reg.region_no) AS region_no FROM bx LEFT JOIN reg ON reg.doc_id = bx.doc_id AND reg.page_no = bx.page_no AND bx.x0 >= reg.x0 - 5 AND bx.y0 >= reg.y0 - 5 AND bx.x1 <= reg.x1 + 5 AND bx.y1 <= reg.y1 + 5 GROUP BY bx.doc_id, bx.page_no, bx.seq")
def table_membership(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    return lay.in_region(rows, lay.table_regions(rows)).select(*KEY, "region_no")


_CELLS = "SELECT doc_id, page_no, c AS cell_no, 60.0 + 160 * (c % 3) AS x0, 15.0 + 54 * (c // 3) AS y0, 60.0 + 160 * (c % 3) + 90 + 30 * (c % 4) AS x1, 15.0 + 54 * (c // 3) + 54 AS y1 FROM (SELECT DISTINCT doc_id, page_no FROM bx), range(0, 48) t(c)"
_PAIRS = _PAGES + f""", cl AS ({_CELLS}),
pr AS (SELECT bx.doc_id, bx.page_no, bx.seq, cl.cell_no, (bx.x0 + bx.x1) / 2 BETWEEN cl.x0 - 0.8 AND cl.x1 + 0.8 AND (bx.y0 + bx.y1) / 2 BETWEEN cl.y0 - 0.8 AND cl.y1 + 0.8 AS holds,
  greatest(1e-6, (cl.x1 - cl.x0) * (cl.y1 - cl.y0)) AS area,
  CASE WHEN least(bx.x1, cl.x1) > greatest(bx.x0, cl.x0) AND least(bx.y1, cl.y1) > greatest(bx.y0, cl.y0) THEN (least(bx.x1, cl.x1) - greatest(bx.x0, cl.x0)) * (least(bx.y1, cl.y1) - greatest(bx.y0, cl.y0)) / greatest(1e-6, (bx.x1 - bx.x0) * (bx.y1 - bx.y0)) ELSE 0.0 END AS ratio
  FROM bx JOIN cl USING (doc_id, page_no))
"""


def cells(rows):
    made = rows.select("doc_id", "page_no").distinct().withColumn("cell_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(47).cast("bigint"))))
    x0, y0 = 60.0 + 160 * (F.col("cell_no") % 3), 15.0 + 54 * F.floor(F.col("cell_no") / 3)
    return made.withColumns({"x0": x0, "y0": y0, "x1": x0 + 90 + 30 * (F.col("cell_no") % 4), "y1": y0 + 54})


@query(
    "cell_assignment", "J5 O8 F20",
    _PAIRS + ", best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no, seq ORDER BY holds DESC, CASE WHEN holds THEN area ELSE -ratio END, cell_no) AS k FROM pr WHERE holds OR ratio >= 0.45) SELECT bx.doc_id, bx.page_no, bx.seq, cell_no FROM bx LEFT JOIN best ON best.doc_id = bx.doc_id AND best.page_no = bx.page_no AND best.seq = bx.seq AND k = 1",
)
def cell_assignment(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    return lay.cell_of(rows, cells(rows)).select(*KEY, "cell_no")


@query(
    "right_limits", "J9 A15",
    _PAGES + """, e AS (SELECT doc_id, page_no, max(x1) FILTER (NOT is_table_cell) AS edge FROM bx GROUP BY doc_id, page_no),
o AS (SELECT a.doc_id, a.page_no, a.seq, min(b.x0 - 4.0) AS near FROM bx a JOIN bx b ON a.doc_id = b.doc_id AND a.page_no = b.page_no AND a.seq <> b.seq AND b.x0 > a.x1 + 1.0
  AND (least(a.y1, b.y1) - greatest(a.y0, b.y0) > least(greatest(1, a.y1 - a.y0), greatest(1, b.y1 - b.y0)) * 0.22 OR abs((b.y0 + b.y1) / 2 - (a.y0 + a.y1) / 2) <= greatest(greatest(1, a.y1 - a.y0), greatest(1, b.y1 - b.y0)) * 0.55)
  GROUP BY a.doc_id, a.page_no, a.seq)
SELECT bx.doc_id, bx.page_no, bx.seq, greatest(greatest(x1 + 2.0, x0 + 12.0), least(least(591.0, greatest(coalesce(edge, 587.0) + 4.0, 595 * 0.90)), coalesce(near, least(591.0, greatest(coalesce(edge, 587.0) + 4.0, 595 * 0.90))))) AS right_limit
FROM bx JOIN e USING (doc_id, page_no) LEFT JOIN o ON o.doc_id = bx.doc_id AND o.page_no = bx.page_no AND o.seq = bx.seq WHERE NOT is_table_cell""",
)
def right_limits(spark, sf_dir):
    return lay.right_limits(boxes(spark, sf_dir)).select(*KEY, "right_limit")


_GROUPS = """, isl AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY seq) - sum(CAST(is_table_cell AS INT)) OVER (PARTITION BY doc_id, page_no ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM bx),
tg AS (SELECT doc_id, page_no, min(seq) AS first_seq, max(seq) AS last_seq, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY min(seq)) AS INTEGER) AS group_no FROM isl WHERE is_table_cell GROUP BY doc_id, page_no, island)
"""


@query("table_groups", "W4 A6", _PAGES + _GROUPS + "SELECT * FROM tg")
def table_groups(spark, sf_dir):
    return lay.table_groups(boxes(spark, sf_dir))


@query("table_drawings", "J10", _PAGES + _GROUPS + "SELECT tg.doc_id, tg.page_no, tg.group_no, d.seq AS drawing_no FROM tg JOIN bx d ON d.doc_id = tg.doc_id AND d.page_no = tg.page_no AND d.seq % 5 = 0 AND d.x0 <= tg.x1 + 2 AND d.x1 >= tg.x0 - 2 AND d.y0 <= tg.y1 + 2 AND d.y1 >= tg.y0 - 2")
def table_drawings(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    return lay.drawings_of(lay.table_groups(rows), rows.where("seq % 5 = 0").withColumnRenamed("seq", "drawing_no"))


@query("table_tops", "A14", _PAGES + "SELECT doc_id, page_no, list_sort(list(DISTINCT y0)) AS tops FROM bx WHERE is_table_cell GROUP BY doc_id, page_no")
def table_tops(spark, sf_dir):
    return boxes(spark, sf_dir).where("is_table_cell").groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_set("y0")).alias("tops"))


@query("block_alignment", "F17", _PAGES + "SELECT doc_id, page_no, seq, CASE WHEN abs((x0 + x1) / 2 - 297.5) < 595 * 0.06 AND abs(x0 - (595 - x1)) < 595 * 0.12 AND (x0 > 595 * 0.28 OR x1 - x0 < 595 * 0.40) THEN 'center' WHEN 595 - x1 < 595 * 0.08 AND x0 > 595 * 0.28 THEN 'right' ELSE 'left' END AS page, CASE WHEN abs(greatest(0, x0 - 70) - greatest(0, 300 - x1)) <= 23 THEN 'center' WHEN greatest(0, 300 - x1) <= 13.8 AND greatest(0, x0 - 70) > greatest(0, 300 - x1) THEN 'right' ELSE 'left' END AS cell FROM bx")
def block_alignment(spark, sf_dir):
    return boxes(spark, sf_dir).select(*KEY, g.block_alignment(F.col("x0"), F.col("x1"), F.lit(595.0)).alias("page"), g.cell_alignment(F.col("x0"), F.col("x1"), F.lit(70.0), F.lit(300.0)).alias("cell"))


@query("span_colours", "F19 F53", "SELECT event_id, CASE WHEN r > 0.95 AND g > 0.95 AND b > 0.95 THEN 0.0 ELSE round(r, 6) END AS r, CASE WHEN r > 0.95 AND g > 0.95 AND b > 0.95 THEN 0.0 ELSE round(b, 6) END AS b, 0.2126 * r * 255 + 0.7152 * g * 255 + 0.0722 * b * 255 < 128 AS dark FROM (SELECT event_id, ((c >> 16) & 255) / 255.0 AS r, ((c >> 8) & 255) / 255.0 AS g, (c & 255) / 255.0 AS b FROM (SELECT event_id, CASE WHEN event_id % 9 = 0 THEN 16777215 ELSE (event_id * 7919) % 16777216 END AS c FROM events))")
def span_colours(spark, sf_dir):
    c = F.when(F.col("event_id") % 9 == 0, F.lit(16777215)).otherwise(F.col("event_id") * 7919 % 16777216).cast("bigint")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", c.alias("c"))
    return rows.select("event_id", F.round(g.rgb(F.col("c")).r, 6).alias("r"), F.round(g.rgb(F.col("c")).b, 6).alias("b"), g.dark(*g.parts(F.col("c"))).alias("dark"))


@query("size_fits", "F48 F59 F60 F45", _PAGES + "SELECT doc_id, page_no, seq, font_size * CASE WHEN length(line) * font_size * 0.55 <= 200 THEN 1.0 ELSE greatest(CASE WHEN is_table_cell THEN 0.90 ELSE 0.96 END, 200 / (length(line) * font_size * 0.55)) END AS shrunk, left(line, CAST(floor(200 / (font_size * 0.55)) AS INTEGER)) AS cut FROM bx")
def size_fits(spark, sf_dir):
    size, line = F.col("font_size"), F.col("line")
    width = g.text_width(line, size)
    return boxes(spark, sf_dir).select(*KEY, g.shrunk_size(size, width, F.lit(200.0), F.col("is_table_cell"), F.lit(False)).alias("shrunk"), g.cut_to_width(line, size, F.lit(200.0)).alias("cut"))


@query("page_shift", "W15", _PAGES + ", ins AS (SELECT doc_id, page_no, y0 AS y, font_size AS extra FROM bx WHERE seq % 7 = 0) SELECT bx.doc_id, bx.page_no, bx.seq, bx.y0 AS y, coalesce((SELECT sum(extra) FROM ins WHERE ins.doc_id = bx.doc_id AND ins.page_no = bx.page_no AND ins.y <= bx.y0), 0.0) AS shift FROM bx")
def page_shift(spark, sf_dir):
    rows = boxes(spark, sf_dir)
    ins = rows.where("seq % 7 = 0").select("doc_id", "page_no", F.col("y0").alias("y"), F.col("font_size").alias("extra"))
    return lay.shift_at(ins, rows.select(*KEY, F.col("y0").alias("y"))).select(*KEY, "y", "shift")


@query("page_strips", "W18", _PAGES + ", ins AS (SELECT doc_id, page_no, y0 AS y, font_size AS extra FROM bx WHERE seq % 7 = 0) SELECT doc_id, page_no, coalesce(lag(y) OVER w, 0.0) AS top, y AS bottom, coalesce(sum(extra) OVER (PARTITION BY doc_id, page_no ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS shift FROM ins WINDOW w AS (PARTITION BY doc_id, page_no ORDER BY y) UNION ALL SELECT doc_id, page_no, max(y), 842.0, sum(extra) FROM ins GROUP BY doc_id, page_no")
def page_strips(spark, sf_dir):
    ins = boxes(spark, sf_dir).where("seq % 7 = 0").select("doc_id", "page_no", F.col("y0").alias("y"), F.col("font_size").alias("extra"))
    return lay.strips(ins)


@query("insertion_needs", "W17", _PAGES + ", a AS (SELECT x.doc_id, x.page_no, x.seq, x.y1, coalesce(min(y.y0) FILTER (y.y0 >= x.y1 - 1), 842.0) AS anchor FROM bx x JOIN bx y USING (doc_id, page_no) GROUP BY x.doc_id, x.page_no, x.seq, x.y1) SELECT doc_id, page_no, seq, anchor, 30.0 - (anchor - y1) AS extra FROM a WHERE 30.0 - (anchor - y1) > 0")
def insertion_needs(spark, sf_dir):
    return lay.insertion_needs(boxes(spark, sf_dir), F.lit(30.0))


# Images of 120 words each hold all words of a document, with boxes and confidence by formula; -1 where a word is a gap.
_WORDS = """WITH raw AS (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS ws FROM documents),
wj AS (SELECT doc_id, generate_subscripts(ws, 1) - 1 AS j, unnest(ws) AS text FROM raw),
w AS (SELECT doc_id * 100000 + j // 120 AS image_id, CAST(j % 120 AS INTEGER) AS k, text FROM wj),
wd AS (SELECT image_id, 6 AS psm, k // 24 AS block_num, 0 AS par_num, k // 6 % 4 AS line_num, k AS word_no, text, CASE WHEN k % 11 = 5 THEN -1.0 ELSE CAST((k * 37) % 100 AS DOUBLE) END AS conf,
  (k % 6) * 60 + 10 AS "left", (k // 6) * 20 + k % 3 AS top, 8 * length(text) AS width, 14 + k % 4 AS height FROM w)
"""
_OCR_LINES = _WORDS + """, l AS (SELECT image_id, block_num, line_num, min("left") AS "left", min(top) AS top, CAST(max("left" + width) AS INTEGER) AS "right", max(top + height) AS bottom, coalesce(avg(conf) FILTER (conf <> -1), 100.0) AS mean_conf,
  coalesce(string_agg(text, ' ' ORDER BY word_no) FILTER (conf >= 30 AND trim(text) <> ''), '') AS a, coalesce(string_agg(text, ' ' ORDER BY word_no) FILTER (conf >= 15 AND trim(text) <> ''), '') AS b FROM wd GROUP BY image_id, block_num, line_num),
ol AS (SELECT image_id, block_num, line_num, "left", top, "right", bottom, mean_conf, CASE WHEN a <> '' THEN a ELSE b END AS text FROM l WHERE a <> '' OR b <> '')
"""


def words(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    w = docs.select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ", -1)).alias("j", "text"))
    w = w.selectExpr("doc_id * 100000 + j div 120 AS image_id", "j % 120 AS k", "text")
    return w.selectExpr("image_id", "6 AS psm", "CAST(k div 24 AS INT) AS block_num", "0 AS par_num", "CAST(k div 6 % 4 AS INT) AS line_num", "k AS word_no", "text", "CASE WHEN k % 11 = 5 THEN -1.0D ELSE CAST((k * 37) % 100 AS DOUBLE) END AS conf", "(k % 6) * 60 + 10 AS `left`", "CAST((k div 6) * 20 + k % 3 AS INT) AS top", "8 * length(text) AS width", "14 + k % 4 AS height")


@query("ocr_lines", "A3 U2 S9 S11", _OCR_LINES + 'SELECT image_id, block_num, line_num, "left", top, "right", bottom, mean_conf, text FROM ol')
def ocr_lines(spark, sf_dir):
    return ocr.words_to_lines(words(spark, sf_dir)).drop("psm", "par_num")


@query("ocr_readable", "F42", _OCR_LINES + """SELECT image_id, block_num, line_num FROM ol WHERE NOT (greatest(1, bottom - top) > 26 OR length(text) > 220 OR (length(trim(text)) <= 2 AND NOT regexp_matches(text, '[0-9%$€£¥]')) OR (length(trim(text)) <= 4 AND mean_conf < 45) OR (mean_conf < 18 AND length(text) > 18))""")
def ocr_readable(spark, sf_dir):
    return ocr.readable(ocr.words_to_lines(words(spark, sf_dir)), F.lit(120)).select("image_id", "block_num", "line_num")


@query("ocr_order", "O5 O6", _OCR_LINES + "SELECT image_id, text, CAST(row_number() OVER (PARTITION BY image_id ORDER BY top, \"left\", text) - 1 AS INTEGER) AS seq FROM ol")
def ocr_order(spark, sf_dir):
    return ocr.in_order(ocr.words_to_lines(words(spark, sf_dir))).select("image_id", "text", "seq")


_WIDE = "greatest(0, least(x.r, c.r) - greatest(x.l, c.l))"
_HIGH = "greatest(0, least(x.b, c.b) - greatest(x.t, c.t))"
_AREA = "greatest(1, ({0}.r - {0}.l) * ({0}.b - {0}.t))"
_LINE = "{'text': c.text, 'l': c.l, 't': c.t, 'r': c.r, 'b': c.b, 'conf': c.conf}"


@query(
    "iou_dedup", "J6 U2",
    _OCR_LINES.replace("WITH ", "WITH RECURSIVE ", 1) + f""", cand AS (SELECT image_id, text, "left" AS l, top AS t, "right" AS r, bottom AS b, mean_conf AS conf FROM ol
  UNION ALL SELECT image_id, text, "left" + line_num, top, "right", bottom, mean_conf + block_num % 3 - 1 FROM ol),
c AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY -conf, t, l, r, b, text) AS k FROM cand),
f AS (SELECT image_id, k, [{_LINE}] AS kept FROM c WHERE k = 1
  UNION ALL SELECT c.image_id, c.k, CASE WHEN len(list_filter(f.kept, lambda x: {_WIDE} * {_HIGH} / ({_AREA.format('x')} + {_AREA.format('c')} - {_WIDE} * {_HIGH}) >= 0.72)) > 0 THEN f.kept ELSE list_append(f.kept, {_LINE}) END
  FROM f JOIN c ON c.image_id = f.image_id AND c.k = f.k + 1),
u AS (SELECT image_id, unnest(kept) AS x FROM (SELECT image_id, kept, row_number() OVER (PARTITION BY image_id ORDER BY k DESC) AS z FROM f) WHERE z = 1)
SELECT image_id, x.text AS text, x.l AS "left", x.t AS top, x.r AS "right", x.b AS bottom, x.conf AS mean_conf FROM u""",
)
def iou_dedup(spark, sf_dir):
    first = ocr.words_to_lines(words(spark, sf_dir))
    moved = first.withColumns({"left": F.col("left") + F.col("line_num"), "mean_conf": F.col("mean_conf") + F.col("block_num") % 3 - 1})
    return ocr.distinct_lines(first.unionByName(moved))


@query(
    "image_coverage", "A10 F40 A13",
    _OCR_LINES + rf"""SELECT image_id, cov AS coverage, wpl AS words_per_line, chars, mode, CASE WHEN mode = 'text' THEN 'A' WHEN score >= 5 AND n >= 4 THEN 'C' ELSE 'B' END AS image_type FROM (
 SELECT *, CASE WHEN cov >= 0.42 AND (chars >= 120 OR wpl >= 5) THEN 'text' ELSE 'image' END AS mode FROM (
  SELECT image_id, least(1.0, sum(greatest(1, ("right" - "left") * (bottom - top))) / 90000.0) AS cov, avg(len(regexp_extract_all(text, '[\pL\pN_]+'))) AS wpl, CAST(length(string_agg(trim(text), chr(10))) AS INTEGER) AS chars, count(*) AS n,
   sum(CASE WHEN regexp_matches(text, '\.{{5,}}|_{{4,}}|-{{4,}}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '_{{3,}}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\b(name|date|address|phone|email|dob|id)\b') THEN 1 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '(^|[^\pL\pN_])(email|cmnd|cccd)($|[^\pL\pN_])') THEN 1 ELSE 0 END) AS score
  FROM ol GROUP BY image_id))""",
)
def image_coverage(spark, sf_dir):
    return ocr.coverage(ocr.words_to_lines(words(spark, sf_dir)), F.lit(90000.0))


@query("logo_lines", "F41", _OCR_LINES + r"SELECT image_id, block_num, line_num FROM ol WHERE len(regexp_extract_all(text, '[\pL\pN_]+')) <= 2 AND length(trim(text)) < 24")
def logo_lines(spark, sf_dir):
    return ocr.words_to_lines(words(spark, sf_dir)).where(t.non_text(F.col("text"))).select("image_id", "block_num", "line_num")


@query("vision_answers", "S10 F30 F31", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'both' ELSE 'text' END AS mode, 'line ' || doc_id AS text, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 END AS n FROM documents""")
def vision_answers(spark, sf_dir):
    mode = F.element_at(F.array(F.lit("image"), F.lit("both"), F.lit("none")), (F.col("doc_id") % 3 + 1).cast("int"))
    said = F.concat(F.lit("IMAGE_TYPE_START\n "), mode, F.lit("\nIMAGE_TYPE_END\nOCR_TEXT_START\nline "), F.col("doc_id").cast("string"), F.lit(" \nOCR_TEXT_END\nTRANSLATED_START\nx\nTRANSLATED_END"))
    low = F.when(F.col("doc_id") % 4 == 0, "0.9").otherwise("0.2")
    body = F.concat(F.lit('Here: {"lines":[{"text":"a","bbox":[0.1,0.1,'), F.lit("0.5,"), low, F.lit(']},{"text":"","bbox":[0,0,1,0.1]},{"text":"b","bbox":[-1,0.1,2,'), low, F.lit(']},{"text":"c","bbox":[0.5,0.5,0.4,0.6]}]} done'))
    m, text, _ = t.vision_sections(said)
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", m.alias("mode"), text.alias("text"), F.size(t.vision_lines(body)).alias("n"))
