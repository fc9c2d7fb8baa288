"""Segments and text rules over documents' lines.

The corpus has no forms, lists or code. Behind its own lines, all of them as they are, each document
gets as many made from them by one expression that both engines read alike.
"""

from pyspark.sql import functions as F

from glosspark.functions import patterns as p
from glosspark.functions import text as t
from glosspark.operators import segments as s
from glosspark.registry import query

_MADE = """CASE CASE WHEN k < n THEN 0 ELSE (k - n) % 22 END
 WHEN 1 THEN concat('Name: ', substring(line, 1, 20), ' ......... Class: ____')
 WHEN 2 THEN concat('1. ', line)
 WHEN 3 THEN '........................'
 WHEN 4 THEN '   '
 WHEN 5 THEN concat('Trang ', CAST(k AS VARCHAR(10)))
 WHEN 6 THEN concat('- ', line)
 WHEN 7 THEN 'getUserName()'
 WHEN 8 THEN 'VARCHAR(255)'
 WHEN 9 THEN 'ma_khach_hang'
 WHEN 10 THEN CASE k % 3 WHEN 0 THEN 'DOB' WHEN 1 THEN 'User   ID' ELSE 'Data types' END
 WHEN 11 THEN concat('Họ tên: ', substring(line, 1, 12), ' MSSV: 222683 a.b@mail.example')
 WHEN 12 THEN '____ - = ;'
 WHEN 13 THEN concat('+ DocGia')
 WHEN 14 THEN concat('orderCode (PK, integer), unitPrice (float): ', substring(line, 1, 9))
 WHEN 15 THEN 'Primary   Key'
 WHEN 16 THEN concat('Email: ', substring(line, 1, 8))
 WHEN 17 THEN 'no  null'
 WHEN 18 THEN concat('• ', substring(line, 1, 40), ' --- ', substring(line, 41, 20))
 WHEN 19 THEN concat('  STUDENT ID is ', substring(line, 1, 5), chr(9), ' Data  types ')
 WHEN 20 THEN concat('Summary [see: ', substring(line, 1, 9), '] of ', substring(line, 10, 30))
 WHEN 21 THEN concat('TV1: (', substring(line, 1, 12), ') title: ', line)
 ELSE line END"""
_LINES = f"""WITH raw AS (SELECT doc_id, len(ls) AS n, unnest(list_concat(ls, ls)) AS line, generate_subscripts(list_concat(ls, ls), 1) - 1 AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
ln AS (SELECT doc_id, CAST(k AS INTEGER) AS line_no, {_MADE} AS line FROM raw)
"""
#: RE2 has no named white space beyond ASCII; the corpus has none either.
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def strip_sql(c):
    return _STRIP.format(c)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def made_lines(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", F.split("text", "\n", -1).alias("ls"), F.size(F.split("text", "\n", -1)).alias("n"))
    made = F.expr(f"transform(concat(ls, ls), (line, k) -> {_MADE})")  # before the explode, so no later filter repeats it
    return rows.select("doc_id", F.posexplode(made).alias("line_no", "line"))


def _q(pattern):
    """A pattern as SQL text for RE2."""
    return "'" + pattern.replace("\\x{", "\\x{").replace("'", "''") + "'"


@query("doc_lines", "S3 F14", "SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents")
def doc_lines(spark, sf_dir):
    return s.lines(documents(spark, sf_dir))


@query("doc_paragraphs", "S3 F43 D8", f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS par_no, paragraph FROM (SELECT doc_id, generate_subscripts(ps, 1) AS n, {strip_sql('unnest(ps)')} AS paragraph FROM (SELECT doc_id, regexp_split_to_array(replace(text, '. ', '.' || chr(10) || chr(10)), '\\n{{2,}}') AS ps FROM documents)) WHERE paragraph <> ''")
def doc_paragraphs(spark, sf_dir):
    return s.paragraphs(documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit(". "), F.lit(".\n\n"))))


@query("doc_sentences", "F43", r"SELECT doc_id, CAST(generate_subscripts(ss, 1) AS INTEGER) AS sent_no, unnest(ss) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM documents)")
def doc_sentences(spark, sf_dir):
    return s.sentences(documents(spark, sf_dir), "text", "doc_id")


@query(
    "txt_chunks", "F43 D8",
    rf"""WITH RECURSIVE par AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS par_no, paragraph FROM (
    SELECT doc_id, generate_subscripts(ps, 1) AS n, {strip_sql('unnest(ps)')} AS paragraph FROM (SELECT doc_id, regexp_split_to_array(text, '\n{{2,}}') AS ps FROM documents)) WHERE paragraph <> ''),
sen AS (SELECT doc_id, par_no, generate_subscripts(ss, 1) AS k, unnest(ss) AS s FROM (SELECT doc_id, par_no, string_split(regexp_replace(paragraph, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM par WHERE length(paragraph) > 3000)),
fold AS (
  SELECT doc_id, par_no, k, s AS cur, CAST(NULL AS VARCHAR) AS done FROM sen WHERE k = 1
  UNION ALL
  SELECT f.doc_id, f.par_no, sen.k, CASE WHEN length(f.cur) + length(sen.s) + 1 <= 3000 THEN f.cur || ' ' || sen.s ELSE sen.s END, CASE WHEN length(f.cur) + length(sen.s) + 1 <= 3000 THEN NULL ELSE f.cur END
  FROM fold f JOIN sen ON sen.doc_id = f.doc_id AND sen.par_no = f.par_no AND sen.k = f.k + 1),
fin AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, par_no ORDER BY k DESC) AS r FROM fold) WHERE r = 1),
pieces AS (
  SELECT doc_id, par_no, 0 AS k, 0 AS i, paragraph AS chunk FROM par WHERE length(paragraph) <= 3000
  UNION ALL SELECT doc_id, par_no, k, 0, done FROM fold WHERE done IS NOT NULL AND done <> ''
  UNION ALL SELECT doc_id, par_no, k + 1, i, substring(cur, CAST(i * 3000 + 1 AS BIGINT), 3000) FROM (SELECT *, unnest(range(0, CAST(ceil(length(cur) / 3000.0) AS BIGINT))) AS i FROM fin))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY par_no, k, i) AS INTEGER) AS chunk_no, chunk FROM pieces""",
)
def txt_chunks(spark, sf_dir):
    return s.chunks(documents(spark, sf_dir))


@query("rejoined_chunks", "F43 A9", r"SELECT doc_id, text AS chunk FROM (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM documents) WHERE text <> '' AND length(text) <= 3000")
def rejoined_chunks(spark, sf_dir):
    few = documents(spark, sf_dir).where((F.length(t.strip(F.col("text"))) <= 3000) & (t.strip(F.col("text")) != ""))
    return s.rejoined(s.chunks(few), "doc_id", "chunk_no", "chunk")


def _leaders(name, leader):
    body = f"regexp_split_to_array(line, '{leader}')"
    marks = f"regexp_extract_all(line, '{leader}')"
    sql = _LINES + f"""SELECT doc_id, line_no, CAST(n AS INTEGER) AS part_no, text, kept FROM (
  SELECT doc_id, line_no, generate_subscripts({body}, 1) * 2 - 2 AS n, unnest({body}) AS text, false AS kept FROM ln
  UNION ALL SELECT doc_id, line_no, generate_subscripts({marks}, 1) * 2 - 1, unnest({marks}), true FROM ln)"""

    @query(name, "F6 S6" if name != "form_fields" else "F7", sql)
    def run(spark, sf_dir):
        return s.leader_parts(made_lines(spark, sf_dir), "line", "doc_id", "line_no", leader=leader)


_leaders("leader_segments", p.LEADER_PDF)
_leaders("leader_segments_docx", p.LEADER_DOCX)
_leaders("leader_segments_image", p.LEADER_IMAGE)
_leaders("form_fields", p.FORM_SPLIT)


def _prefix(name, pattern):
    @query(name, "F8", _LINES + f"SELECT doc_id, line_no, regexp_extract(line, {_q(pattern)}, 1) AS prefix, substring(line, length(regexp_extract(line, {_q(pattern)}, 1)) + 1) AS body FROM ln")
    def run(spark, sf_dir):
        return s.with_prefix(made_lines(spark, sf_dir), "line", pattern).drop("line")


_prefix("list_prefix", p.LIST_PREFIX_TEXT)
_prefix("list_prefix_pdf", p.LIST_PREFIX_PDF)


@query("edge_space", "F1", _LINES + r"SELECT doc_id, line_no, regexp_extract(line, '(?s)^(\s*)(.*?)(\s*)$', 1) AS lead, regexp_extract(line, '(?s)^(\s*)(.*?)(\s*)$', 2) AS core, regexp_extract(line, '(?s)^(\s*)(.*?)(\s*)$', 3) AS tail FROM ln")
def edge_space(spark, sf_dir):
    a, b, c = t.edges(F.col("line"))
    return made_lines(spark, sf_dir).select("doc_id", "line_no", a.alias("lead"), b.alias("core"), c.alias("tail"))


@query("control_codes", "F9", "SELECT doc_id, replace(replace(text, chr(10), '[[LB]]'), chr(9), '[[TAB]]') AS encoded, text AS decoded FROM documents")
def control_codes(spark, sf_dir):
    coded = documents(spark, sf_dir).select("doc_id", t.encode_controls(F.col("text")).alias("encoded"))
    return coded.withColumn("decoded", t.decode_controls(F.col("encoded")))


def _flag(name, ops, column, sql):
    @query(name, ops, _LINES + f"SELECT doc_id, line_no, {sql} AS {name} FROM ln")
    def run(spark, sf_dir):
        return made_lines(spark, sf_dir).select("doc_id", "line_no", column(F.col("line")).alias(name))


_CORE = strip_sql("line")
_COUNT = "len(regexp_extract_all({0}, '{1}'))"
_flag("translatable", "F2", t.translatable, f"{_CORE} <> '' AND {_COUNT.format(_CORE, chr(92) + 'pL')} >= 2")
_flag("translatable_latin", "F2", lambda c: t.translatable(c, letter=p.LETTER_LATIN), f"{_CORE} <> '' AND {_COUNT.format(_CORE, '[A-Za-zÀ-ỹ]')} >= 2")
_flag("translatable_legacy", "F2b", lambda c: t.translatable(c, 0), f"{_CORE} <> '' AND regexp_matches({_CORE}, '[\\pL]')")
_flag("translatable_body", "F2c", t.any_letter, "regexp_matches(line, '[A-Za-zÀ-ỹ]')")
_flag("vietnamese_like", "F3", t.vietnamese, f"regexp_matches(lower(line), '{p.VIETNAMESE}')")
_flag("structural_line", "F4", t.structural, r"NOT regexp_matches(line, '[\pL\pN_\x{C0}-\x{1EF9}]')")
_flag("filler_line", "F5 A12", t.filler, rf"CASE WHEN {_CORE} = '' THEN true WHEN {_COUNT.format(_CORE, chr(92) + 'pL')} >= 5 THEN false WHEN regexp_matches({_CORE}, '^[\._\-=:;\s]+$') THEN length(regexp_replace({_CORE}, '\s', '', 'g')) >= 4 ELSE regexp_matches({_CORE}, '\.{{5,}}|_{{4,}}|-{{4,}}') END")
_flag("page_number_line", "F15", lambda c: c.rlike(p.PAGE_NUMBER), f"regexp_matches(line, '{p.PAGE_NUMBER}')")
_flag("list_line", "F15", lambda c: c.rlike(p.LIST_LAYOUT), f"regexp_matches(line, {_q(p.LIST_LAYOUT)})")
_flag("form_label_line", "F15", lambda c: c.rlike("(?iu)" + p.FORM_FIELD), f"regexp_matches(line, {_q('(?i)' + p.FORM_FIELD)})")
_TOKEN = " OR ".join(f"regexp_matches({_CORE}, {_q(k)})" for k in (p.FUNC_CALL_TOKEN, p.CODE_IDENT_TOKEN, p.NUMBER_HEADING, p.SHORT_ABBREVIATION, p.SQL_TYPE, p.DB_CONSTRAINT))
_BARE = strip_sql(f"regexp_replace({_CORE}, {_q(p.BULLET_PREFIX)}, '')")
_NONSEM = f"({_CORE} = '' OR lower({_CORE}) IN {p.NONTRANSLATABLE} OR {_TOKEN} OR ({_BARE} <> '' AND {_BARE} <> {_CORE} AND regexp_matches({_BARE}, {_q(p.PASCAL_IDENT)})))"
_flag("code_token", "F21", t.nonsemantic, _NONSEM)
_CELL = (
    f"({_NONSEM} OR (regexp_matches({_CORE}, '^[A-Za-z0-9_]{{2,24}}$') AND (regexp_matches({_CORE}, '[0-9]') OR (regexp_matches({_CORE}, '[A-Z]') AND regexp_matches({_CORE}, '[a-z]') AND NOT regexp_matches({_CORE}, '^[A-Z][^A-Z]*[a-z][^A-Z]*$')))))"
)
_flag("code_cell", "F21", lambda c: t.nonsemantic(c, True), _CELL)
_KEY = f"lower(regexp_replace({_CORE}, '\\s+', ' ', 'g'))"


def _case(table):
    return "CASE " + _KEY + " " + " ".join("WHEN '{}' THEN '{}'".format(k, v) for k, v in table.items()) + " END"


_flag("constraint_text", "F22 J3", t.constraint_text, f"CASE WHEN regexp_matches(lower({_CORE}), '^(not|no)\\s*null$') THEN 'Not NULL' ELSE {_case(p.CONSTRAINT_TEXT)} END")
_flag("glossary_text", "J3 D4", lambda c: t.mapped(c, p.GLOSSARY), _case(p.GLOSSARY))
_flag("table_header", "F24 J3", lambda c: t.mapped(c, p.TABLE_HEADERS), _case(p.TABLE_HEADERS))
_CLEAN = "line"
for _pattern, _by in p.CLEANUP:
    _CLEAN = f"regexp_replace({_CLEAN}, {_q(_pattern.replace('(?iu)', '(?i)'))}, '{_by}', 'g')"
_flag("cleaned_line", "F24", t.cleaned, _CLEAN)
_flag("code_dominated_calls", "F23", lambda c: F.regexp_count(c, F.lit(p.CODE_CALL)) + F.regexp_count(c, F.lit(p.TYPED_IDENT)), f"CAST({_COUNT.format('line', p.CODE_CALL)} + {_COUNT.format('line', p.TYPED_IDENT)} AS INTEGER)")
_flag("code_dominated", "F23", t.code_dominated, f"{_COUNT.format('line', p.CODE_CALL)} >= 2 OR {_COUNT.format('line', p.TYPED_IDENT)} >= 2 OR {_COUNT.format('line', p.CLASS_LISTING)} >= 2 OR len(list_filter(regexp_extract_all(line, '[A-Za-zÀ-ỹ0-9]+'), lambda w: regexp_matches(w, '^([A-Z][a-z]+([A-Z][a-zA-Z0-9]*)+|[a-z]+[A-Z][a-zA-Z0-9]*)$'))) >= 2")
_flag("single_line", "F58", t.single_line, rf"{strip_sql(r'''regexp_replace(line, '\s{2,}', ' ', 'g')''')}")
_flag("profile_leader", "F25", t.profile_leader, rf"CASE WHEN {_CORE} = '' OR (lower(line) LIKE '%email%' AND lower(line) LIKE '%class%') OR (contains(line, chr(9)) AND NOT regexp_matches(line, '\.{{3,}}')) OR NOT regexp_matches({_CORE}, '(?i)^(\s*)(student\s*id|email|class)\s*[:\-]?\s*(.*)$') OR {strip_sql(rf'''regexp_replace(regexp_extract({_CORE}, '(?i)^(\s*)(student\s*id|email|class)\s*[:\-]?\s*(.*)$', 3), '^[.\-_:\s]+', '')''')} = '' THEN line ELSE CASE WHEN regexp_matches({_CORE}, '(?i)^student') THEN 'Student Id:' WHEN regexp_matches({_CORE}, '(?i)^class') THEN 'Class:' ELSE 'Email:' END || chr(9) || {strip_sql(rf'''regexp_replace(regexp_extract({_CORE}, '(?i)^(\s*)(student\s*id|email|class)\s*[:\-]?\s*(.*)$', 3), '^[.\-_:\s]+', '')''')} END")
_flag("non_text_line", "F41", t.non_text, rf"{_CORE} = '' OR (len(regexp_extract_all({_CORE}, '[\pL\pN_]+')) <= 2 AND length({_CORE}) < 24)")
_flag("error_kind", "F56 ST5", lambda c: t.error_kind(c), f"CASE WHEN regexp_matches(line, '{p.FAIL_FAST_WORDS}') THEN 'stop' WHEN regexp_matches(line, '{p.RETRY_WORDS}') THEN 'retry' ELSE 'fail' END")
_flag("inline_symbols", "F35 F54", t.inline_symbols, r"regexp_replace(line, '^(\s*[•+\-*◦o])(\S)', '\1 \2')")
_flag("answer_cleaned", "F37", t.answer_cleaned, rf"{strip_sql(rf'''regexp_replace(replace({_CORE}, '**', ''), '  +', ' ', 'g')''')}")


@query(
    "form_score", "A13 F40",
    _LINES + rf"""SELECT doc_id, CAST(sum(CASE WHEN regexp_matches({_CORE}, '\.{{5,}}|_{{4,}}|-{{4,}}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches({_CORE}, '_{{3,}}') THEN 2 ELSE 0 END
 + CASE WHEN regexp_matches({_CORE}, '(?i)\b(name|date|address|phone|email|dob|id)\b') THEN 1 ELSE 0 END
 + CASE WHEN regexp_matches(lower({_CORE}), '(^|[^\pL\pN_])(họ tên|ngày|địa chỉ|số điện thoại|email|cmnd|cccd)($|[^\pL\pN_])') THEN 1 ELSE 0 END) AS INTEGER) AS score, count(*) >= 4 AND sum(CASE WHEN regexp_matches({_CORE}, '\.{{5,}}|_{{4,}}|-{{4,}}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches({_CORE}, '_{{3,}}') THEN 2 ELSE 0 END
 + CASE WHEN regexp_matches({_CORE}, '(?i)\b(name|date|address|phone|email|dob|id)\b') THEN 1 ELSE 0 END
 + CASE WHEN regexp_matches(lower({_CORE}), '(^|[^\pL\pN_])(họ tên|ngày|địa chỉ|số điện thoại|email|cmnd|cccd)($|[^\pL\pN_])') THEN 1 ELSE 0 END) >= 5 AS form_like FROM ln WHERE {_CORE} <> '' GROUP BY doc_id""",
)
def form_score(spark, sf_dir):
    core = t.strip(F.col("line"))
    got = made_lines(spark, sf_dir).select("doc_id", core.alias("c")).where("c <> ''").groupBy("doc_id").agg(F.sum(t.form_score(F.array("c"))).cast("int").alias("score"), F.count("*").alias("n"))
    return got.select("doc_id", "score", ((F.col("n") >= 4) & (F.col("score") >= 5)).alias("form_like"))


@query(
    "image_mode", "F39",
    _LINES + rf""", c AS (SELECT doc_id, line_no, {strip_sql('line')} AS raw FROM ln UNION ALL SELECT doc_id, -1, {strip_sql('text')} FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, line_no, raw, list_filter(list_transform(string_split(raw, chr(10)), lambda y: {strip_sql('y')}), lambda y: y <> '') AS ls FROM c),
w AS (SELECT doc_id, line_no, raw, list_transform(ls, lambda y: len(regexp_extract_all(y, '[\pL\pN_]+'))) AS ns, len(regexp_extract_all(raw, '\pL')) AS al, len(regexp_extract_all(raw, '[\p{{Lu}}\p{{Lo}}\p{{Lm}}]')) AS up FROM l)
SELECT doc_id, line_no, CASE WHEN raw = '' OR length(raw) >= 120 OR len(regexp_extract_all(raw, '[\pL\pN_]+')) >= 25 THEN 'text'
 WHEN {' OR '.join(f"contains(lower(raw), '{x}')" for x in p.PROMO_WORDS)} OR (al > 0 AND up * 1.0 / al >= 0.5 AND list_avg(ns) <= 4) OR (len(list_filter(ns, lambda n: n <= 3)) >= 3 AND list_avg(ns) <= 3) OR doc_id % 11 = 0 THEN 'image' ELSE 'text' END AS mode FROM w""",
)
def image_mode(spark, sf_dir):
    own = made_lines(spark, sf_dir).unionByName(documents(spark, sf_dir).where("text is not null").select("doc_id", F.lit(-1).alias("line_no"), F.col("text").alias("line")))
    return own.select("doc_id", "line_no", t.image_mode(F.col("line"), F.lit(""), F.when(F.col("doc_id") % 11 == 0, "Image")).alias("mode"))


_LONG = r"regexp_matches(core, '(^|[^\pL\pN_])\d{{{},}}($|[^\pL\pN_])')"


@query(
    "incomplete_translation", "F33 F34",
    _LINES + rf""", c AS (SELECT *, {_CORE} AS core FROM ln)
SELECT doc_id, line_no, line_no % 5 <> 0 AND line_no % 3 <> 0 AND core <> '' AND (regexp_matches(core, '{p.EMAIL}') OR {_LONG.format(6)} OR (regexp_matches(core, '(?i)mssv') AND {_LONG.format(5)}) OR regexp_matches(core, '(?i)lớp\s*:') OR regexp_matches(core, '(?i)họ\s*&?\s*tên') AND regexp_matches(core, '(?i)mssv')) AS incomplete,
 line_no % 5 = 0 AND core <> '' AND regexp_matches(line, '[A-Za-z]') AND NOT regexp_matches(lower(line), '{p.VIETNAMESE}') AS unchanged FROM c""",
)
def incomplete_translation(spark, sf_dir):
    rows = made_lines(spark, sf_dir)
    out = F.when(F.col("line_no") % 5 == 0, F.col("line")).when(F.col("line_no") % 3 == 0, F.concat(F.lit("Student ID 222683 a.b@mail.example "), F.col("line"))).otherwise(F.lit("Student name"))
    return rows.select("doc_id", "line_no", t.incomplete(F.col("line"), out).alias("incomplete"), t.unchanged_english(F.col("line"), out).alias("unchanged"))


@query(
    "instruction_echo", "F32",
    _LINES + f"SELECT doc_id, line_no, {_CORE} = '' OR line_no % 4 = 0 AND NOT contains(lower(line), '## ') OR line_no % 4 = 1 AND length({_CORE}) BETWEEN 1 AND 180 AND length({strip_sql('repeat(line, 6)')}) > greatest(450, 4 * length({_CORE})) AS echo FROM ln",
)
def instruction_echo(spark, sf_dir):
    out = F.when(F.col("line_no") % 4 == 0, F.concat(F.lit("QA Checklist "), F.col("line"))).when(F.col("line_no") % 4 == 1, F.repeat("line", 6)).otherwise(F.col("line"))
    return made_lines(spark, sf_dir).select("doc_id", "line_no", t.instruction_echo(F.col("line"), out).alias("echo"))


@query("bilingual_inline", "F26", _LINES + f"SELECT doc_id, line_no, CASE WHEN line_no % 6 = 0 OR {_CORE} = '' THEN {_CORE} ELSE {_CORE} || ' / ' || replace({_CORE}, 'e', 'E') END AS joined FROM ln")
def bilingual_inline(spark, sf_dir):
    dst = F.when(F.col("line_no") % 6 == 0, " ").otherwise(F.replace("line", F.lit("e"), F.lit("E")))
    return made_lines(spark, sf_dir).select("doc_id", "line_no", t.bilingual(F.col("line"), dst, " / ").alias("joined"))


@query("batch_payloads", "F14 W16 J7", _LINES + """, n AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS k FROM ln)
SELECT doc_id, CAST(k // 30 AS INTEGER) AS batch_no, string_agg('__R' || lpad(CAST(k % 30 + 1 AS VARCHAR), 3, '0') || '__ ' || line, chr(10) ORDER BY k) AS payload FROM n GROUP BY doc_id, k // 30""")
def batch_payloads(spark, sf_dir):
    return s.packed_batches(s.numbered_batches(made_lines(spark, sf_dir), 30, "line_no"), "line")


@query("batch_answers", "F14 J7", _LINES + f""", n AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS k FROM ln)
SELECT doc_id, CAST(k // 30 AS INTEGER) AS batch_no, CAST(k % 30 + 1 AS INTEGER) AS row_no, replace({_CORE}, 'e', 'E') AS text FROM n""")
def batch_answers(spark, sf_dir):
    sent = s.packed_batches(s.numbered_batches(made_lines(spark, sf_dir), 30, "line_no"), "line")
    return s.parsed_batches(sent.withColumn("payload", F.replace("payload", F.lit("e"), F.lit("E"))))


@query("ocr_text_fixed", "F36", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(x, '([)\]}>])([a-zA-Z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}])', '\1 \2', 'g'), '([a-zA-Z\x{C0}-\x{24F}\x{1E00}-\x{1EFF}])(\()', '\1 \2', 'g'), '  +', ' ', 'g') AS fixed FROM (SELECT doc_id, replace(replace(regexp_replace(text, '[^a-zA-Z .,]', '', 'g'), ', ', '(ab)'), '. ', '  ') AS x FROM documents)""")
def ocr_text_fixed(spark, sf_dir):
    made = documents(spark, sf_dir).select("doc_id", F.replace(F.replace(F.regexp_replace("text", "[^a-zA-Z .,]", ""), F.lit(", "), F.lit("(ab)")), F.lit(". "), F.lit("  ")).alias("x"))
    return made.select("doc_id", t.ocr_fixed(F.col("x")).alias("fixed"))


@query("token_budgets", "F55", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN least(4096, greatest(3072, CAST(floor(value * 100) AS BIGINT))) WHEN 1 THEN least(4096, greatest(2048, CAST(floor(value * 100) AS BIGINT))) ELSE least(2048, greatest(64, CAST(floor(value * 100) AS BIGINT))) END AS tokens FROM events")
def token_budgets(spark, sf_dir):
    context = F.element_at(F.array(F.lit("document_pdf_run_batch"), F.lit("document_pdf_adjacent_inline"), F.lit("document")), (F.col("event_id") % 3 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", t.token_budget(F.floor(F.col("value") * 100), context).alias("tokens"))
