"""Text functions as column expressions; all run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from glosspark.functions import patterns as p


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip(c: Column) -> Column:
    """Without white space at either end, of any script's kind; SQL's trim drops blanks only."""
    return F.btrim(text_of(c), F.lit(p.WHITE))


def edges(c: Column) -> tuple[Column, Column, Column]:
    """White space before, the text, white space after; of blank text all is before."""
    full = rf"(?s)\A({p.SPACE}*)(.*?)({p.SPACE}*)\z"
    return tuple(F.regexp_extract(text_of(c), full, i) for i in (1, 2, 3))


def letters(c: Column, of: str = r"\pL") -> Column:
    return F.regexp_count(text_of(c), F.lit(of))


def has_letters(c: Column, least: int, letter: str = r"\pL") -> Column:
    """Whether there are ``least`` letters; a match ends at the last one needed, where a count reads all."""
    other = letter.replace("[", "[^", 1) if letter.startswith("[") else letter.replace("p", "P", 1)
    return text_of(c).rlike(f"(?:{letter}{other}*+){{{least}}}")


def vietnamese(c: Column) -> Column:
    return F.lower(text_of(c)).rlike(p.VIETNAMESE)


def structural(c: Column) -> Column:
    """Nothing to translate: no letter, number or underscore, nor any of the Latin extensions."""
    return ~text_of(c).rlike(r"[\pL\pN_\x{C0}-\x{1EF9}]")


def translatable(c: Column, least_letters: int = 2, letter: str = r"\pL", skip_vietnamese: bool = False) -> Column:
    """Not blank, not only digits and symbols, and with letters enough.

    ``letter=patterns.LETTER_LATIN`` is the older rule, which has no letters in Chinese, Japanese
    or Korean; ``least_letters=0`` is the rule without a count.
    """
    core = strip(c)
    out = core.rlike(r"[\pL\p{Nl}\p{No}]") if least_letters == 0 else core != ""
    out = out & has_letters(core, least_letters, letter) if least_letters else out
    return out & ~vietnamese(core) if skip_vietnamese else out


def any_letter(c: Column) -> Column:
    return text_of(c).rlike(p.LETTER_LATIN)


def filler(c: Column) -> Column:
    """Blank, four or more fill characters and nothing else, or a long leader with few letters."""
    core = strip(c)
    few = ~has_letters(core, 5)
    only = core.rlike(rf"\A{p.FILLER_CHARS}\z")
    return F.when(core == "", True).when(~few, False).when(only, F.length(F.regexp_replace(core, p.SPACE, "")) >= 4).otherwise(core.rlike(r"\.{5,}|_{4,}|-{4,}"))


def parts(c: Column, delimiter: str) -> Column:
    """array<struct<text, kept>>: text and the delimiters between, in order; ``kept`` marks the latter."""
    body = text_of(c)
    texts = F.split(body, delimiter, -1)
    marks = F.regexp_extract_all(body, F.lit(f"({delimiter})"), 0)
    pairs = F.transform(texts, lambda t, i: F.array(F.struct(t.alias("text"), F.lit(False).alias("kept")), F.struct(F.get(marks, i).alias("text"), F.lit(True).alias("kept"))))
    return F.filter(F.flatten(pairs), lambda x: x.text.isNotNull())


def list_prefix(c: Column, pattern: str = p.LIST_PREFIX_TEXT) -> tuple[Column, Column]:
    prefix = F.regexp_extract(text_of(c), pattern, 1)
    return prefix, F.substr(text_of(c), F.length(prefix) + 1)


def encode_controls(c: Column) -> Column:
    return F.replace(F.regexp_replace(text_of(c), r"\r\n|\n|\r", "[[LB]]"), F.lit("\t"), F.lit("[[TAB]]"))


def decode_controls(c: Column) -> Column:
    steps = (("[[LB]]", "\n"), ("[[TAB]]", "\t"), ("__LB__", "\n"), ("__TAB__", "\t"))
    return reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), steps, text_of(c))


def nonsemantic(c: Column, in_table: Column | bool = False) -> Column:
    """A token to keep as it is: code, abbreviations, types, constraints, codes within cells."""
    t = strip(c)
    bare = strip(F.regexp_replace(t, p.BULLET_PREFIX, ""))
    kinds = (p.FUNC_CALL_TOKEN, p.CODE_IDENT_TOKEN, p.NUMBER_HEADING, p.SHORT_ABBREVIATION, p.SQL_TYPE, p.DB_CONSTRAINT)
    token = reduce(lambda a, k: a | t.rlike(k), kinds, (t == "") | F.lower(t).isin(*p.NONTRANSLATABLE))
    listed = (bare != "") & (bare != t) & bare.rlike(p.PASCAL_IDENT)
    titled = t.rlike(r"\A[A-Z][^A-Z]*[a-z][^A-Z]*\z")
    code = t.rlike(r"\A[A-Za-z0-9_]{2,24}\z") & (t.rlike("[0-9]") | (t.rlike("[A-Z]") & t.rlike("[a-z]") & ~titled))
    cell = F.lit(in_table) if isinstance(in_table, bool) else in_table
    return token | listed | (cell & code)


def code_dominated(c: Column) -> Column:
    return reduce(lambda a, k: a | (F.regexp_count(text_of(c), F.lit(k)) >= 2), (p.CODE_CALL, p.TYPED_IDENT, p.CLASS_LISTING, p.MULTI_CAP_IDENT), F.lit(False))


def mapped(c: Column, table: dict[str, str]) -> Column:
    """The table's entry for the text in lower case with single blanks, else null."""
    key = F.lower(F.regexp_replace(strip(c), r"\s+", " "))
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[key]


def constraint_text(c: Column) -> Column:
    return F.when(F.lower(strip(c)).rlike(r"\A(?:not|no)\s*null\z"), "Not NULL").otherwise(mapped(c, p.CONSTRAINT_TEXT))


def cleaned(c: Column, phrases: bool = False) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), (*(p.PHRASES if phrases else ()), *p.CLEANUP), text_of(c))


def delimiter_of(given: str | None) -> str:
    return ((given or "").strip() or "|")[:10]


def bilingual(src: Column, dst: Column, delimiter: str | None = None, keep_edges: bool = False) -> Column:
    """``src | dst``; an empty side leaves the other. ``keep_edges`` joins the texts as they stand."""
    d, s, t = delimiter_of(delimiter), strip(src), strip(dst)
    a, b = (text_of(src), text_of(dst)) if keep_edges else (s, t)
    return F.when(t == "", a).when(s == "", b).otherwise(F.concat(a, F.lit(f" {d} "), b))


def instruction_echo(src: Column, out: Column) -> Column:
    """Whether a model's answer looks like its instructions rather than a translation."""
    o, s = strip(out), text_of(src)
    low, own = F.lower(o), F.lower(s)
    has = lambda c: reduce(lambda a, m: a | F.contains(c, F.lit(m)), p.ECHO_MARKERS, F.lit(False))
    n = F.length(strip(s))
    breaks = lambda c: F.regexp_count(c, F.lit("\n"))
    return (o == "") | (has(low) & ~has(own)) | ((n > 0) & (n <= 180) & (F.length(o) > F.greatest(F.lit(450), n * 4))) | (breaks(o) > breaks(s) + 6)


def unchanged_english(src: Column, out: Column) -> Column:
    s = strip(src)
    return (s != "") & (s == strip(out)) & s.rlike("[A-Za-z]") & ~vietnamese(s)


def incomplete(src: Column, out: Column) -> Column:
    """Whether addresses, long numbers, student numbers or classes of the source are missing."""
    s, d = strip(src), strip(out)
    missing = lambda pattern: F.exists(F.regexp_extract_all(s, F.lit(pattern), 0), lambda x: ~F.contains(d, x))
    number = rf"(?<![\pL\pN_])\d{{%d,}}(?![\pL\pN_])"
    mssv, lop = s.rlike("(?i)mssv"), s.rlike(r"(?iu)lớp\s*:")
    short = ~d.rlike(r"(?iu)class\s*:|lớp\s*:") & (F.length(d) < F.greatest(F.lit(24), F.floor(F.length(s) * 0.42)))
    value = F.rtrim(F.regexp_extract(s, r"(?iu)lớp\s*:\s*([^\s|]+)", 1), F.lit("."))
    lost = (F.length(value) >= 4) & value.rlike("[A-Za-z0-9]") & ~F.contains(d, value)
    name = s.rlike(r"(?iu)họ\s*&?\s*tên|họ\s+tên") & mssv & ~d.rlike(r"(?i)student\s*id|mssv") & ~d.rlike(number % 5)
    return (s != "") & (d != "") & (missing(p.EMAIL) | missing(number % 6) | (mssv & missing(number % 5)) | (lop & (short | lost)) | name)


def inline_symbols(c: Column) -> Column:
    out = reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), p.SYMBOLS.items(), text_of(c))
    return F.regexp_replace(F.regexp_replace(out, r"^(\s*)[\x{E000}-\x{F8FF}]+", "$1•"), r"^(\s*[•+\-*◦o])(\S)", "$1 $2")


def ocr_fixed(c: Column) -> Column:
    """Blanks put back between syllables and around brackets; blanks in a row made one."""
    out = F.regexp_replace(text_of(c), rf"(?iu)([{p.TONE_VOWELS}])({p.INITIALS})(?=[{p.ALL_VOWELS}])", "$1 $2")
    out = F.regexp_replace(out, rf"([)\]}}>])({p.LETTER_EXTENDED})", "$1 $2")
    out = F.regexp_replace(out, rf"({p.LETTER_EXTENDED})(\()", "$1 $2")
    out = F.regexp_replace(out, rf"(^|(?<=\s))([+\-])({p.LETTER_EXTENDED})", "$2 $3")
    return F.when(F.length(c) < 2, c).otherwise(F.regexp_replace(out, "  +", " "))


def answer_cleaned(c: Column) -> Column:
    """A model's answer without a leading bar, wrapping quotes, bold marks and repeated blanks."""
    out = strip(c)
    out = F.when(F.startswith(out, F.lit("|")), strip(F.substr(out, F.lit(2)))).otherwise(out)
    quoted = (F.length(out) >= 2) & F.left(out, F.lit(1)).isin('"', "'") & (F.left(out, F.lit(1)) == F.right(out, F.lit(1)))
    out = F.when(quoted, strip(F.substr(out, F.lit(2), F.length(out) - 2))).otherwise(out)
    return strip(F.regexp_replace(F.replace(out, F.lit("**"), F.lit("")), "  +", " "))


def single_line(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(text_of(c), r"[\r\n]+", " "), r"\s{2,}", " "))


def word_count(c: Column) -> Column:
    return F.regexp_count(text_of(c), F.lit(p.WORD + "+"))


def non_text(c: Column) -> Column:
    """A logo rather than text: blank, or at most two words and under 24 characters."""
    core = strip(c)
    return (core == "") | ((word_count(core) <= 2) & (F.length(core) < 24))


def image_mode(text: Column, translated: Column, advised: Column) -> Column:
    """Whether a picture's translation goes below it ('text') or over it ('image')."""
    raw = strip(text)
    lines = F.filter(F.transform(F.split(raw, r"\r\n|\n|\r"), strip), lambda x: x != "")
    counts = F.transform(lines, word_count)
    n = F.greatest(F.size(lines), F.lit(1))
    average = F.aggregate(counts, F.lit(0), lambda a, x: a + x) / n
    alphabetic, upper = letters(raw), letters(raw, r"[\p{Lu}\p{Lo}\p{Lm}]")
    ratio = F.when(alphabetic > 0, upper / alphabetic).otherwise(0.0)
    short = F.size(F.filter(counts, lambda x: x <= 3))
    both = F.concat(F.lower(raw), F.lit("\n"), F.lower(text_of(translated)))
    promo = reduce(lambda a, w: a | F.contains(both, F.lit(w)), p.PROMO_WORDS, F.lit(False))
    banner = promo | ((ratio >= 0.5) & (average <= 4)) | ((short >= 3) & (average <= 3))
    return F.when((raw == "") | (F.length(raw) >= 120) | (word_count(raw) >= 25), "text").when(banner | (F.lower(text_of(advised)) == "image"), "image").otherwise("text")


def form_score(lines: Column, leader: str = p.LEADER_IMAGE) -> Column:
    """Points of an array of lines for looking like a form."""
    one = lambda x: (
        F.when(x.rlike(leader), 2).otherwise(0) + F.when(x.rlike("_{3,}"), 2).otherwise(0) + F.when(x.rlike(p.FORM_WORDS_EN), 1).otherwise(0) + F.when(F.lower(x).rlike(p.FORM_WORDS_VI), 1).otherwise(0)
    )
    return F.aggregate(lines, F.lit(0), lambda a, x: a + one(x))


def reflowed(c: Column) -> Column:
    """Recognised lines joined into prose: a line goes on unless it ends a sentence or the next is a list item.
    Lines of one character that is no digit are dropped."""
    lines = F.transform(F.split(F.regexp_replace(text_of(c), r"\r\n|\r", "\n"), "\n"), lambda x: F.regexp_replace(strip(x), r"\s+", " "))
    kept = F.filter(lines, lambda x: (F.length(x) > 1) | x.rlike("[0-9]"))
    joined = F.aggregate(
        kept, F.lit(""),
        lambda a, x: F.when(a == "", x).when(a.rlike(r"[.!?:;]\z") | x.rlike(r"^(-|\*|\d+[.)])\s+"), F.concat(a, F.lit("\n"), x)).otherwise(F.concat(a, F.lit(" "), x)),
    )
    return joined


def text_chunks(c: Column, most: int = 3000) -> Column:
    """Provider-sized pieces of a plain text: paragraphs, or sentences packed up to ``most`` characters.

    A sentence over the limit in the middle of its paragraph stays whole; the last piece is sliced.
    Packing greedily is what a greedy pattern does: the longest run of whole sentences that fits,
    else one sentence.
    """
    paragraphs = F.filter(F.transform(F.split(text_of(c), "\n{2,}"), strip), lambda x: x != "")
    ends = r"(?:(?<=[.!?])(?= )|\z)"
    pattern = rf"(?s)(.{{1,{most}}}{ends}|.+?{ends}) ?"

    def packed(par: Column) -> Column:
        pieces = F.regexp_extract_all(F.regexp_replace(par, r"(?<=[.!?])\s+", " "), F.lit(pattern), 1)
        last = F.element_at(pieces, -1)
        slices = F.transform(F.sequence(F.lit(0), F.floor((F.length(last) - 1) / most).cast("int")), lambda i: F.substring(last, i * most + 1, F.lit(most)))
        return F.concat(F.slice(pieces, F.lit(1), F.size(pieces) - 1), slices)

    return F.flatten(F.transform(paragraphs, lambda par: F.when(F.length(par) <= most, F.array(par)).otherwise(packed(par))))


def vision_sections(c: Column) -> tuple[Column, Column, Column]:
    """(mode, text, translation) of a marked answer; without markers all of it is the text."""
    mode = F.lower(F.regexp_extract(text_of(c), r"(?i)IMAGE_TYPE_START\s*\n\s*(text|image|both)\s*\n\s*IMAGE_TYPE_END", 1))
    read = strip(F.regexp_extract(text_of(c), r"(?s)OCR_TEXT_START\s*\n(.*?)\nOCR_TEXT_END", 1))
    done = strip(F.regexp_extract(text_of(c), r"(?s)TRANSLATED_START\s*\n(.*?)\nTRANSLATED_END", 1))
    return F.when(mode == "", "text").otherwise(mode), F.when((read == "") & (done == ""), strip(c)).otherwise(read), done


def vision_lines(c: Column) -> Column:
    """Checked lines of a JSON answer: array<struct<text, bbox>>, boxes of four numbers clamped to 0..1."""
    body = F.regexp_extract(text_of(c), r"(?s)(\{.*\})", 1)
    got = F.from_json(body, "lines array<struct<text:string,bbox:array<double>>>").lines
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    fine = F.filter(got, lambda x: (strip(x.text) != "") & (F.size(x.bbox) == 4) & F.forall(x.bbox, lambda v: v.isNotNull()))
    boxed = F.transform(fine, lambda x: F.struct(strip(x.text).alias("text"), F.transform(x.bbox, clamp).alias("bbox")))
    return F.filter(boxed, lambda x: (x.bbox[2] > x.bbox[0]) & (x.bbox[3] > x.bbox[1]) & (x.bbox[3] - x.bbox[1] <= 0.25) & (F.length(x.text) <= 260))


def error_kind(c: Column) -> Column:
    return F.when(text_of(c).rlike(p.FAIL_FAST_WORDS), "stop").when(text_of(c).rlike(p.RETRY_WORDS), "retry").otherwise("fail")


def profile_leader(c: Column) -> Column:
    """``Label:<tab>value`` for lines of a student number, address or class; others as they are."""
    raw = text_of(c)
    pattern = r"(?i)^(\s*)(student\s*id|email|class)\s*[:\-]?\s*(.*)$"
    core = strip(raw)
    value = strip(F.regexp_replace(F.regexp_extract(core, pattern, 3), r"^[.\-_:\s]+", ""))
    skip = (core == "") | (F.lower(raw).contains("email") & F.lower(raw).contains("class")) | (raw.contains("\t") & ~raw.rlike(r"\.{3,}")) | ~core.rlike(pattern) | (value == "")
    return F.when(skip, raw).otherwise(F.concat(F.initcap(F.lower(F.regexp_extract(core, pattern, 2))), F.lit(":\t"), value))


def token_budget(chars: Column, context: Column, default: int = 900) -> Column:
    """Output tokens to ask for: 64 to 2048, and for inline and batch work 2048 or 3072 to 4096."""
    floor = F.when(context == "document_pdf_run_batch", 3072).when(context == "document_pdf_adjacent_inline", 2048).otherwise(64)
    top = F.when(context.isin("document_pdf_run_batch", "document_pdf_adjacent_inline"), 4096).otherwise(2048)
    return F.least(top, F.greatest(floor, F.coalesce(chars, F.lit(default))))
