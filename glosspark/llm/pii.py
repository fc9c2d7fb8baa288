"""Personal data with offset-preserving deobfuscation.

Base identifiers are matched on the text as it stands. A chain of transducers then rewrites
disguises (look-alike letters and digits, characters of no width, spelled digits, at and dot in
words or brackets) into plain characters; every character of the result knows the source span
it came from. The same patterns run on the result, and a match that needed a rewrite is mapped
back to source offsets and added, unless a base span of its kind holds it already.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm.common import map_arrow, map_batches, text_of, utf8

KINDS = ("email", "ip", "card", "phone")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NOT_DIGIT = re.compile("[^0-9]")

#: Letters of other scripts that pass for Latin ones.
LOOK_ALIKES = dict(
    zip(
        "аеорсхуіѕјԁһкмтвнАЕОРСХУІЅЈКМТВНοανρικυτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
        "aeopcxyisjdhkmtbhAEOPCXYISJKMTBHoavpikutABEZHIKMNOPTYX",
        strict=True,
    )
)
NO_WIDTH = frozenset("\u00ad\u200b\u200c\u200d\u2060\ufeff")
#: Full stop, dashes and a blank that pass for the plain ones between digits.
SEPARATORS = {"\u3002": ".", "\u00a0": " ", **dict.fromkeys("\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "-")}
#: Endings that a bare "at ... dot" must lead to; those that are common words would catch prose.
TOP_LEVEL = "com|org|net|edu|gov|info|biz|io|co|ai|app|dev|uk|de|fr|es|pl|nl|ru|cn|jp|br|au|ca|ch|eu|example|test"
#: Spelled digits: English, German, French, Spanish.
DIGITS = {
    w: str(n)
    for words in (
        "zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun",
        "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve",
    )
    for n, w in enumerate(words.split())
}
AT_WORDS, DOT_WORDS = "at|arroba|arobase", "dot|punto|point|punkt"
_WORD = "|".join(sorted(DIGITS, key=len, reverse=True))
_SPELLED = re.compile(rf"\b(?:{_WORD})(?:(?:[ \t]*[,-][ \t]*|[ \t]+)(?:{_WORD}|oh)\b)+", re.I)
_BY_DOT = re.compile(rf"\b(?:{_WORD})\b(?=[ \t]+(?:{DOT_WORDS})[ \t])|(?:{'|'.join(rf'(?<=\b{w} )' for w in DOT_WORDS.split('|'))})(?:{_WORD})\b", re.I)
_DIGIT_WORD = re.compile(rf"\b(?:{_WORD}|oh)\b", re.I)
_PLUS = re.compile(r"\bplus[ \t]+(?=[0-9])", re.I)
_GAP = r"(?:[ \t]+|_|-)"
_BOX_AT, _BOX_DOT = (rf"[ \t]*[(\[{{<][ \t]*(?:{w})[ \t]*[)\]}}>][ \t]*" for w in (f"{AT_WORDS}|@", rf"{DOT_WORDS}|\."))
_REF_AT, _REF_DOT = "&(?:#0*64|#x0*40|commat);", "&(?:#0*46|#x0*2e|period);"  # character references
_SAID_DOT = rf"(?:{_GAP}(?:{DOT_WORDS}){_GAP}|{_BOX_DOT})"
_AT = re.compile(
    rf"{_BOX_AT}|{_REF_AT}|(?<=[A-Za-z0-9])[ \t]+@[ \t]*(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])@[ \t]+(?=[A-Za-z0-9])"
    rf"|(?<=[A-Za-z0-9]){_GAP}(?:{AT_WORDS}){_GAP}(?=[A-Za-z0-9]+(?:{_SAID_DOT}[A-Za-z0-9]+)*{_SAID_DOT}(?:{TOP_LEVEL})\b)", re.I,
)
_DOT = re.compile(rf"{_BOX_DOT}|{_REF_DOT}|(?<=[A-Za-z0-9]){_GAP}(?:{DOT_WORDS}){_GAP}(?=[A-Za-z0-9])|(?<=[A-Za-z0-9])[ \t]+\.[ \t]+(?=[A-Za-z0-9])", re.I)
_LETTER_DIGIT = re.compile(r"(?<=[0-9])[OoIl]+(?![A-Za-z])|(?<![A-Za-z])[OoIl]+(?=[0-9])|(?<=[0-9][ -])[OoIl]{2,4}(?![A-Za-z])")
_AS_DIGIT = str.maketrans("OoIl", "0011")
# A cheap look at the bytes for anything that a transducer would rewrite.
_BEYOND_LATIN_1 = re.compile(rb"[\xc4-\xff]")
_HINT_WORDS = tuple(w.encode() for w in DOT_WORDS.split("|"))
_HINT_BOX = re.compile(rf"[(\[{{<][ \t]*(?:{AT_WORDS}|{DOT_WORDS}|@|\.)[ \t]*[)\]}}>]|{_REF_AT}|{_REF_DOT}".encode(), re.I)
_HINT_AT, _HINT_DOT = re.compile(rb"[ \t]@|@[ \t]"), (b" . ", b" .\t", b"\t. ", b"\t.\t")
_HINT_DIGIT = re.compile(rb"[0-9][ -]?[OoIl]|[OoIl][0-9]")
_DIGIT_WORDS = frozenset(w.encode("latin-1") for w in DIGITS)
_PARTED = bytes(i if chr(i).isalnum() or chr(i) == "_" else 32 for i in range(256))


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What finditer gives, tried only where there is an at sign."""
    done, at = 0, text.find("@")
    while at >= 0:
        s = at
        while s > done and text[s - 1] in _LOCAL_CHARS:
            s -= 1
        m = _EMAIL.match(text, s) if s < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def matches(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start."""
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


@cache
def _plain(c: str) -> str | None:
    """The ASCII character that ``c`` passes for; "" for no width, None if it stands for itself."""
    if c in NO_WIDTH:
        return ""
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    if c in SEPARATORS:
        return SEPARATORS[c]
    if (d := unicodedata.decimal(c, None)) is not None:
        return str(d)
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() and folded.isprintable() and ord(c) > 255 else None


class Tape:
    """Text with the source span of each character and whether it was rewritten."""

    def __init__(self, text: str):
        n = len(text)
        self.text, self.start, self.end, self.new = text, array("q", range(n)), array("q", range(1, n + 1)), bytearray(n)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [start, end) of the present text by strings; the edits are in order and apart."""
        if not edits:
            return
        text, start, end, new, at = [], array("q"), array("q"), bytearray(), 0
        for s, e, by in edits:
            text += [self.text[at:s], by]
            start += self.start[at:s] + self.start[s : s + 1] * len(by)
            end += self.end[at:s] + self.end[e - 1 : e] * len(by)
            new += self.new[at:s] + b"\1" * len(by)
            at = e
        text.append(self.text[at:])
        self.text, self.start, self.end, self.new = "".join(text), start + self.start[at:], end + self.end[at:], new + self.new[at:]
        # a character that takes up dropped neighbours keeps its own span; what is dropped belongs to none


def _spelled(text: str) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), "".join(DIGITS.get(w.lower(), "0") for w in _DIGIT_WORD.findall(m[0]))) for m in _SPELLED.finditer(text)]


def normalise(text: str) -> Tape:
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite([(i, i + 1, p) for i, c in enumerate(text) if c > "\x7f" and (p := _plain(c)) is not None])
    tape.rewrite(_spelled(tape.text))
    tape.rewrite([(*m.span(), DIGITS[m[0].lower()]) for m in _BY_DOT.finditer(tape.text)])
    tape.rewrite([(*m.span(), m[0].translate(_AS_DIGIT)) for m in _LETTER_DIGIT.finditer(tape.text)])
    for rule, by in ((_AT, "@"), (_DOT, "."), (_PLUS, "+")):
        tape.rewrite([(*m.span(), by) for m in rule.finditer(tape.text)])
    return tape


def disguised(raw: bytes) -> bool:
    """Whether the text holds anything that a transducer would rewrite."""
    if not raw.isascii() and (b"\xc2\xad" in raw or b"\xc2\xa0" in raw or _BEYOND_LATIN_1.search(raw)):
        return True
    low = raw.lower() if raw.isascii() else raw.decode().lower().encode("latin-1")
    if any(w in low for w in _HINT_WORDS) and (_DOT.search(text := raw.decode()) or _BY_DOT.search(text)):
        return True
    if b"plus" in low and _PLUS.search(raw.decode()):
        return True
    if any(c in raw for c in (b"(", b"[", b"{", b"<", b"&")) and _HINT_BOX.search(raw):
        return True
    if (b"@" in raw and _HINT_AT.search(raw)) or any(d in raw for d in _HINT_DOT):
        return True
    if len(raw.translate(None, b"0123456789")) < len(raw) and _HINT_DIGIT.search(raw):
        return True
    words = low.translate(_PARTED).split()
    return not _DIGIT_WORDS.isdisjoint(words) and any(a in _DIGIT_WORDS and (b in _DIGIT_WORDS or b == b"oh") for a, b in zip(words, words[1:]))


def find(raw: bytes | None) -> list[tuple[int, int, int, bool]]:
    """(kind number, start, end, base) by kind, then start; offsets in code points of the source.

    What is no UTF-8 counts as one code point, U+FFFD, for each ill-formed part.
    """
    if not raw:
        return []
    text = text_of(raw)
    if "\ufffd" in text:
        raw = text.encode()
    base = matches(text)
    out = [(*m, True) for m in base]
    if disguised(raw):
        tape = normalise(text)
        known = set(base)
        for kind, s, e in matches(tape.text):
            if not any(tape.new[s:e]) and tape.end[e - 1] - tape.start[s] == e - s:
                continue
            span = (kind, tape.start[s], tape.end[e - 1])
            if span not in known and not any(k == kind and a <= span[1] and span[2] <= b for k, a, b in base):
                out.append((*span, False))
    return sorted(out)


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind,start,stop,base>>) for every row.

    A null or empty text has no spans. Repeated rows and null ids are rows of their own; other
    columns are not read; an empty table gives no rows.
    """
    picked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.bool_())])

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [[{"kind": KINDS[k], "start": s, "stop": e, "base": b} for k, s, e, b in find(raw)] for raw in utf8(batch.column("text"))]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(span))], names=["doc_id", "spans"])

        return work

    return map_batches(picked, make, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,stop:bigint,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """Counts and span digests of ``find_pii``'s rows."""
    of = lambda kind: F.filter("spans", lambda s: s.kind == kind)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.stop)), ",")
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed(F.filter("spans", lambda s: s.base)).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


def masked(raw: bytes | None) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    if raw is None:
        return None
    text, out, at, until = text_of(raw), [], 0, 0
    for k, s, e, _ in sorted(find(raw), key=lambda x: (x[1], -x[2])):
        if s >= until:
            out += [text[at:s], f"[{KINDS[k].upper()}]"]
        until = at = max(until, e)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced by its kind, and ``n_chars`` (where there) to match.

    All rows, columns and their order stay; a null text stays null.
    """
    names = docs.columns

    def run(batches):
        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            at = names.index(text)
            cols[at] = pa.array([masked(raw) for raw in utf8(cols[at])], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    out = map_arrow(docs, run, docs.schema)
    if n_chars in names:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out
