"""Lines of a page merged by choices that depend on choices before, held against recursive SQL.

The SQL walks a page line by line with a state in a recursive query, as the folds do in Python.
"""

from pyspark.sql import functions as F

from glosspark.functions import patterns as p
from glosspark.operators import layout as lay
from glosspark.operators import sequential as seq
from glosspark.plans.layout import _CLASS, _PAGES, boxes
from glosspark.plans.segments import _q, strip_sql
from glosspark.registry import query

_TAIL = r"[.\s…·]"
_C = strip_sql("line")
_BARE = f"regexp_replace(core, '{_TAIL}+$', '')"
_REST = rf"regexp_replace(regexp_replace({_BARE}, '\([^)]*\)\s*$', ''), '{_TAIL}+$', '')"
_OPEN = rf"({_C} <> '' AND NOT ({_C} LIKE '%.' AND {_C} NOT LIKE '%..') AND NOT regexp_matches({_C}, '(^|[?!;:)»\"'']){_TAIL}*$'))"
_OPEN_TYPED = rf"""CASE WHEN {_BARE} = '' THEN false
  WHEN starts_with(core, '(') AND {_BARE} LIKE '%)' AND (length(replace({_BARE}, '(', '')) <> length(replace({_BARE}, ')', '')) OR ({_REST} <> '' AND right({_REST}, 1) NOT IN ('?', '!', ';', ':'))) THEN true
  ELSE right({_BARE}, 1) NOT IN ('?', '!', ';', ':', ')', '»', '"', '''') END"""
_PRE = f"left(core, i - 1)"
_DEPTH = f"length(replace(replace({_PRE}, ')', ''), ']', '')) - length(replace(replace({_PRE}, '(', ''), '[', ''))"
_LABEL = f"regexp_matches(core, ':( |$)') AND len(list_filter(range(5, length(core) + 1), lambda i: substring(core, i, 1) = ':' AND NOT regexp_matches(substring(core, i - 1, 1), '[0-9]') AND substring(core, i + 1, 1) IN ('', ' ') AND {_DEPTH} <= 0)) > 0"
_HEADING = rf"regexp_matches(core, '^(\d+[.)]\s|[a-zA-Z][.)]\s|[-–—•+]\s|[IVX]+[.)]\s)')"


def _recursive(sql):
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _folded(spark, sf_dir, fold):
    return seq.per_page(lay.classified(boxes(spark, sf_dir)), fold)


# --- bullets beside their text ----------------------------------------------------------------

_MARKS = {
    "seq": "seq * 2 + h",
    "line": "CASE WHEN h = 0 THEN CASE seq % 7 WHEN 0 THEN '•' WHEN 1 THEN '-' WHEN 2 THEN 'x' WHEN 3 THEN '' WHEN 4 THEN 'o' WHEN 5 THEN '+' ELSE '' END ELSE line END",
    "x0": "CASE WHEN h = 0 THEN x0 - 5.5 - (seq * 7 % 31 - 3) ELSE x0 END",
    "y0": "CASE WHEN h = 0 THEN y0 + seq % 3 * 4 ELSE y0 END",
    "x1": "CASE WHEN h = 0 THEN x0 - (seq * 7 % 31 - 3) ELSE x1 END",
    "y1": "CASE WHEN h = 0 THEN y1 + seq % 3 * 4 ELSE y1 END",
}
_MARKED = ", ".join(f"{v} AS {k}" for k, v in _MARKS.items())
_SYMBOLS = "line"
for _old, _new in p.SYMBOLS.items():
    _SYMBOLS = f"replace({_SYMBOLS}, '{_old}', '{_new}')"
_SYMBOLS = rf"regexp_replace(regexp_replace({_SYMBOLS}, '^(\s*)[\x{{E000}}-\x{{F8FF}}]+', '\1•'), '^(\s*[•+\-*◦o])(\S)', '\1 \2')"


def merged_prefixes_sql(member):
    """Marks joined to their text, of boxes in ``mk`` in the order of seq; ``member`` names a box."""
    return rf"""WITH RECURSIVE b AS (SELECT *, {_C} AS core, {_SYMBOLS} AS shown, (y0 + y1) / 2 AS mid, greatest(1.0, y1 - y0) AS high, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY seq) AS k FROM mk),
t AS (SELECT a.*, n.k IS NOT NULL AND a.core <> '' AND n.core <> '' AND NOT n.is_table_cell AND regexp_matches(n.line, '\pL') AND (regexp_matches(a.core, '[\x{{E000}}-\x{{F8FF}}]') OR a.core IN {seq.PREFIXES})
  AND abs(a.mid - n.mid) <= 0.65 * greatest(a.high, n.high) AND n.x0 - a.x1 BETWEEN -1.0 AND 24.0 AS pair,
  n.shown AS nshown, n.x0 AS nx0, n.y0 AS ny0, n.x1 AS nx1, n.y1 AS ny1, n.{member} AS nmember
  FROM b a LEFT JOIN b n ON n.doc_id = a.doc_id AND n.page_no = a.page_no AND n.k = a.k + 1),
f AS (SELECT doc_id, page_no, k, coalesce(pair, false) AS taken, false AS gone FROM t WHERE k = 1
  UNION ALL SELECT t.doc_id, t.page_no, t.k, coalesce(t.pair, false) AND NOT f.taken, f.taken FROM f JOIN t ON t.doc_id = f.doc_id AND t.page_no = f.page_no AND t.k = f.k + 1),
o AS (SELECT t.*, taken, {strip_sql('shown')} AS mark, regexp_replace(nshown, '^\s+', '') AS body FROM t JOIN f USING (doc_id, page_no, k) WHERE NOT gone)
SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY k) - 1 AS INTEGER) AS seq,
  CASE WHEN taken THEN mark || CASE WHEN mark = '' OR body = '' OR left(body, 1) IN (':', ')', ']', '}}') THEN '' ELSE ' ' END || body ELSE shown END AS text,
  CASE WHEN taken THEN least(x0, nx0) ELSE x0 END AS x0, CASE WHEN taken THEN least(y0, ny0) ELSE y0 END AS y0, CASE WHEN taken THEN greatest(x1, nx1) ELSE x1 END AS x1, CASE WHEN taken THEN greatest(y1, ny1) ELSE y1 END AS y1,
  CASE WHEN taken THEN [CAST({member} AS INTEGER), CAST(nmember AS INTEGER)] ELSE [CAST({member} AS INTEGER)] END AS members FROM o"""


@query("prefixes_merged", "W6", _recursive(_PAGES) + f", mk AS (SELECT doc_id, page_no, is_table_cell, {_MARKED} FROM bx, (VALUES (0), (1)) v(h)) SELECT * FROM (" + merged_prefixes_sql("seq") + ")")
def prefixes_merged(spark, sf_dir):
    both = boxes(spark, sf_dir).withColumn("h", F.explode(F.array(F.lit(0), F.lit(1))))
    return seq.per_page(both.selectExpr("doc_id", "page_no", "is_table_cell", *[f"{v} AS {k}" for k, v in _MARKS.items()]), seq.prefixes_merged)


# --- lines to paragraphs ----------------------------------------------------------------------

_GROUPED = """SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY base, late, first) - 1 AS INTEGER) AS seq, text, x0, y0, x1, y1, members FROM (
SELECT doc_id, page_no, base, late, min(k) AS first, CASE WHEN count(*) = 1 THEN min(line) ELSE coalesce(string_agg({said}, ' ' ORDER BY k) FILTER ({said} <> ''), '') END AS text,
  min(b.x0) AS x0, arg_min(b.y0, k) AS y0, max(b.x1) AS x1, arg_max(b.y1, k) AS y1, list(CAST(seq AS INTEGER) ORDER BY k) AS members
FROM f JOIN b USING (doc_id, page_no, k) WHERE own IS NOT NULL GROUP BY doc_id, page_no, base, late, own)"""


@query(
    "paragraphs_merged", "W7 A6",
    _recursive(_PAGES) + rf""", b AS (SELECT *, {_C} AS core, {_OPEN} AS open, length({_C}) <= 2 AND regexp_matches({_C}, '{p.LONE_BULLET}') AS lone, regexp_matches(line, {_q(p.MERGE_LIST_START)}) AS item, regexp_matches(line, ',\s*$') AS comma,
  row_number() OVER (PARTITION BY doc_id, page_no ORDER BY seq) AS k FROM bx),
f AS (SELECT doc_id, page_no, k, k AS base, 0 AS late, k AS own, NOT lone AS active, 1 AS n, x0 AS left_edge, font_size AS lsize, is_bold AS lbold, is_italic AS lital, y1 AS ly1, open AS lopen, comma AS lcomma FROM b WHERE k = 1
  UNION ALL
  SELECT doc_id, page_no, k, CASE WHEN pass OR goes THEN base ELSE k END, CASE WHEN pass THEN 1 ELSE 0 END, CASE WHEN goes THEN base ELSE k END, CASE WHEN pass OR goes THEN true ELSE NOT lone END, CASE WHEN pass THEN n WHEN goes THEN n + 1 ELSE 1 END,
    CASE WHEN pass OR goes THEN left_edge ELSE x0 END, CASE WHEN pass THEN lsize ELSE font_size END, CASE WHEN pass THEN lbold ELSE is_bold END, CASE WHEN pass THEN lital ELSE is_italic END, CASE WHEN pass THEN ly1 ELSE y1 END, CASE WHEN pass THEN lopen ELSE open END, CASE WHEN pass THEN lcomma ELSE comma END
  FROM (SELECT b.*, f.base, f.n, f.left_edge, f.lsize, f.lbold, f.lital, f.ly1, f.lopen, f.lcomma, f.active AND f.n < {seq.MERGE_MOST} AND b.lone AS pass,
      f.active AND f.n < {seq.MERGE_MOST} AND NOT b.lone AND b.is_bold = f.lbold AND b.is_italic = f.lital AND abs(b.font_size - f.lsize) <= 2 AND b.y0 - f.ly1 BETWEEN -2 AND f.lsize * CASE WHEN f.lopen THEN 2.0 ELSE 1.4 END
      AND CASE WHEN b.item THEN f.lopen AND abs(b.x0 - f.left_edge) <= f.lsize * 2.5 ELSE abs(b.x0 - f.left_edge) <= f.lsize * 2.5 OR f.lcomma END AS goes
    FROM f JOIN b ON b.doc_id = f.doc_id AND b.page_no = f.page_no AND b.k = f.k + 1))
""" + _GROUPED.format(said="core"),
)
def paragraphs_merged(spark, sf_dir):
    return _folded(spark, sf_dir, seq.paragraphs_merged)


@query(
    "typed_paragraphs", "W8",
    _recursive(_CLASS) + rf""", b AS (SELECT * EXCLUDE (n), {_OPEN_TYPED} AS open, regexp_matches(line, '(?s)[A-Za-zÀ-ỹ].*[A-Za-zÀ-ỹ]') AS wanted, {_HEADING} AS heading, {_LABEL} AS label, layout_type IN ('paragraph', 'list_item') AS body,
  layout_type IN ('dotted_placeholder', 'form_field') AS filled, CASE WHEN layout_type IN ('dotted_placeholder', 'form_field') THEN trim(regexp_replace(core, '{_TAIL}{{4,}}', ' ', 'g')) ELSE core END AS said,
  row_number() OVER (PARTITION BY doc_id, page_no ORDER BY seq) AS k FROM r),
f AS (SELECT doc_id, page_no, k, k AS base, 0 AS late, k AS own, body AND wanted AND NOT heading AS active, 1 AS n, is_bold AS fbold, is_italic AS fital, font_size AS lsize, x0 AS lx0, y1 AS ly1, open AS lopen FROM b WHERE k = 1
  UNION ALL
  SELECT doc_id, page_no, k, CASE WHEN pass OR goes THEN base ELSE k END, 0, CASE WHEN pass THEN NULL WHEN goes THEN base ELSE k END, CASE WHEN pass OR goes THEN true ELSE body AND wanted AND NOT heading END, CASE WHEN pass THEN n WHEN goes THEN n + 1 ELSE 1 END,
    CASE WHEN pass OR goes THEN fbold ELSE is_bold END, CASE WHEN pass OR goes THEN fital ELSE is_italic END, CASE WHEN pass THEN lsize ELSE font_size END, CASE WHEN pass THEN lx0 ELSE x0 END, CASE WHEN pass THEN ly1 ELSE y1 END, CASE WHEN pass THEN lopen ELSE open END
  FROM (SELECT b.*, f.base, f.n, f.fbold, f.fital, f.lsize, f.lx0, f.ly1, f.lopen, f.active AND f.n < {seq.MERGE_MOST_TYPED} AND NOT b.wanted AND f.lopen AND b.layout_type = 'whitespace' AS pass,
      f.active AND f.n < {seq.MERGE_MOST_TYPED} AND b.wanted AND NOT b.heading AND NOT b.label AND CASE WHEN f.lopen THEN b.body OR b.filled ELSE b.body AND b.is_bold = f.fbold AND b.is_italic = f.fital AND abs(b.x0 - f.lx0) <= f.lsize * 3 END
      AND b.y0 - f.ly1 BETWEEN -2 AND f.lsize * CASE WHEN f.lopen THEN 2.5 ELSE 1.5 END AND abs(b.font_size - f.lsize) <= 2 AS goes
    FROM f JOIN b ON b.doc_id = f.doc_id AND b.page_no = f.page_no AND b.k = f.k + 1))
""" + _GROUPED.format(said="said"),
)
def typed_paragraphs(spark, sf_dir):
    return _folded(spark, sf_dir, seq.typed_paragraphs)


# --- pieces of one form row -------------------------------------------------------------------

_FORMS = "CASE seq % 6 WHEN 0 THEN concat('Email: ', substring(line, 1, 8)) WHEN 1 THEN 'MSSV: 222683' WHEN 2 THEN line WHEN 3 THEN 'Ngày sinh: 1/2' WHEN 4 THEN concat(' sv: ', substring(line, 1, 60)) ELSE 'email' END"
_MOVED = "x0 + CASE WHEN page_no % 2 = 0 THEN 40 ELSE 0 END * (seq % 3)"
_FORM = rf"{_C} <> '' AND length({_C}) <= 240 AND (regexp_matches({_C}, {_q('(?i)' + p.FORM_FIELD)}) OR regexp_matches({_C}, '(?i)\b(mssv|msv|email|lớp|khóa|họ\s+tên|sv\b|mã\s*số)\b'))"


@query(
    "form_rows_merged", "W9",
    _recursive(_PAGES) + rf""", b AS (SELECT *, {_C} AS core, {_FORM} AS form, (y0 + y1) / 2 AS mid FROM (SELECT * REPLACE ({_FORMS} AS line, {_MOVED} AS x0) FROM bx)),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, seq) AS k FROM b),
f AS (SELECT doc_id, page_no, k, k AS own, mid AS base, x1 AS lx1 FROM o WHERE k = 1
  UNION ALL SELECT o.doc_id, o.page_no, o.k, CASE WHEN abs(o.mid - f.base) > 3.5 OR o.x0 - f.lx1 > 36 THEN o.k ELSE f.own END, CASE WHEN abs(o.mid - f.base) > 3.5 OR o.x0 - f.lx1 > 36 THEN o.mid ELSE f.base END, o.x1
  FROM f JOIN o ON o.doc_id = f.doc_id AND o.page_no = f.page_no AND o.k = f.k + 1),
h AS (SELECT o.*, own, count(*) OVER w >= 2 AND bool_and(form) OVER w AS whole FROM f JOIN o USING (doc_id, page_no, k) WINDOW w AS (PARTITION BY doc_id, page_no, own)),
u AS (SELECT doc_id, page_no, min(k) AS first, CASE WHEN count(*) = 1 THEN min(line) ELSE string_agg(core, ' ' ORDER BY k) END AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, list(CAST(seq AS INTEGER) ORDER BY k) AS members FROM h GROUP BY doc_id, page_no, CASE WHEN whole THEN own ELSE -k END)
SELECT doc_id, page_no, CAST(row_number() OVER (PARTITION BY doc_id, page_no ORDER BY y0, x0, first) - 1 AS INTEGER) AS seq, text, x0, y0, x1, y1, members FROM u""",
)
def form_rows_merged(spark, sf_dir):
    rows = boxes(spark, sf_dir).withColumn("line", F.expr(_FORMS)).withColumn("x0", F.expr(_MOVED))
    return seq.per_page(rows, seq.form_rows)
