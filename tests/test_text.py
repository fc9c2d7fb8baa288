import pytest
from pyspark.sql import functions as F

from glosspark.functions import patterns as p
from glosspark.functions import text as t


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()[0]


# Golden cases of filler lines; a name is replaced.
FILLER = [
    ("Ho Ten TV1: A B C .......MSSV: 222683.......", False), ("Ten de tai: Website hoc lap trinh - X.......", False), ("Tom tat noi dung de tai: ...", False),
    ("Phan tich thiet ke he thong: Co ......", False), ("." * 44, True), ("_" * 28, True), ("", True), ("1", False), ("AB", False), ("....", True),
]


@pytest.mark.parametrize(("text", "want"), FILLER)
def test_filler(spark, text, want):
    assert one(spark, t.filler(F.col("a")), a=text) is want


@pytest.mark.parametrize(("text", "want"), [("Tên trường", "Field name"), ("Kiểu  dữ liệu", "Data type"), ("Ràng buộc", "Constraint"), ("not  null", "Not NULL"), ("No NULL", "Not NULL"), ("other", None), (None, None)])
def test_constraint_text(spark, text, want):
    assert one(spark, t.constraint_text(F.col("a")), a=text) == want


@pytest.mark.parametrize(("text", "want"), [("Họ", False), ("×", False), ("÷", False), ("\u0301", False), ("\uf0b7", True), ("…!?", True), ("_", False), ("١", False), ("", True), (None, True)])
def test_structural(spark, text, want):
    assert one(spark, t.structural(F.col("a")), a=text) is want


def test_chinese_has_letters_but_not_by_the_older_rule(spark):
    assert one(spark, t.translatable(F.col("a")), a="数据库") is True
    assert one(spark, t.translatable(F.col("a"), letter=p.LETTER_LATIN), a="数据库") is False


def test_strip_is_not_trim(spark):
    assert one(spark, t.strip(F.col("a")), a="\t  x y \n") == "x y"


@pytest.mark.parametrize(("src", "dst", "want"), [("a", "b", "a | b"), ("a", " ", "a"), (" ", "b", "b"), (None, None, ""), (" a ", "b", "a | b")])
def test_bilingual(spark, src, dst, want):
    assert one(spark, t.bilingual(F.col("a"), F.col("b")), a=src, b=dst) == want
    assert t.delimiter_of("  ") == "|" and t.delimiter_of("x" * 20) == "x" * 10


@pytest.mark.parametrize(
    ("src", "dst", "want"),
    [("mail a@b.com", "thư", True), ("mail a@b.com", "thư a@b.com", False), ("số 1234567", "number", True), ("MSSV: 12345", "Student ID", True), ("lớp: DH22TIN07", "class: x", True), ("lớp: DH22TIN07", "class: DH22TIN07", False), ("", "x", False), ("họ tên MSSV", "name", True)],
)
def test_incomplete(spark, src, dst, want):
    assert one(spark, t.incomplete(F.col("a"), F.col("b")), a=src, b=dst) is want


@pytest.mark.parametrize(("src", "out", "want"), [("a", "", True), ("a", "You are a professional translator", True), ("a", "x" * 451, True), ("a" * 181, "x" * 900, False), ("a", "b\n" * 8, True), ("a", "b", False)])
def test_instruction_echo(spark, src, out, want):
    assert one(spark, t.instruction_echo(F.col("a"), F.col("b")), a=src, b=out) is want


def chunks(text, most):
    import re

    out = []
    for par in [x.strip() for x in re.split(r"\n{2,}", text) if x.strip()]:
        if len(par) <= most:
            out.append(par)
            continue
        cur = ""
        for s in re.split(r"(?<=[.!?])\s+", par):
            if len(cur) + len(s) + 1 <= most:
                cur = f"{cur} {s}".strip()
            else:
                out += [cur] if cur else []
                cur = s
        out += [cur[i : i + most] for i in range(0, len(cur), most)]
    return out


@pytest.mark.parametrize("text", ["", "a\n\n\nb", "One. Two! Three? " * 9, "x" * 95 + ". short", "short. " + "x" * 95, "x" * 40 + ". " + "y" * 70 + ". z", "\n\n \n\n", "a.  b!\n c? " * 20, "x" * 29 + ". y. z." + " w" * 30, "." * 70, ". . . " * 20, "ab c " * 40 + "."])
def test_chunks(spark, text):
    got = one(spark, t.text_chunks(F.col("a"), 30), a=text)
    assert got == chunks(text, 30)


@pytest.mark.parametrize(("text", "want"), [("SALE 50%", "image"), ("", "text"), ("word " * 30, "text"), ("A B\nC D", "image"), ("a quiet line of words that says little", "text")])
def test_image_mode(spark, text, want):
    assert one(spark, t.image_mode(F.col("a"), F.lit(""), F.lit("")), a=text) == want


def test_reflow(spark):
    assert one(spark, t.reflowed(F.col("a")), a="one\r\ntwo.\nx\n7\n- item\nthree") == "one two.\n7\n- item three"


def test_ocr_fixes(spark):
    assert one(spark, t.ocr_fixed(F.col("a")), a="Hệthống (cửviên) a(b)c  +Sach") == "Hệ thống (cử viên) a (b) c + Sach"


def test_parts_join_to_the_whole(spark):
    for text in ["a...b___c", "...", "", "a : b.....", "x"]:
        got = one(spark, t.parts(F.col("a"), p.FORM_SPLIT), a=text)
        assert "".join(x.text for x in got) == text
        assert [x.kept for x in got] == [bool(k % 2) for k in range(len(got))]


def test_error_kinds(spark):
    assert [one(spark, t.error_kind(F.col("a")), a=x) for x in ("HTTP 429", "Timed out", "bad")] == ["stop", "retry", "fail"]
