"""Font names; files and glyphs are a renderer's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes in the order that they are dropped, families by fragment in the order that they are tried.
SUFFIXES = ("-boldmt", "-bolditalicmt", "-italicmt", "-boldobliquemt", "psmt", "-bold", "-italic", "-oblique", "-regular", "mt", "ps", " bold", " italic", " regular", ",bold", ",italic")
FAMILIES = ("timesnewroman", "couriernew", "courier", "symbol", "calibri", "cambria", "georgia", "garamond", "palatino", "arial", "helvetica", "verdana", "tahoma", "trebuchet", "consolas", "dejavusans")
SAME_AS = {"couriernew": "courier", "helvetica": "arial", "dejavusans": "arial"}
SYMBOL_WORDS = ("symbol", "wingdings", "webdings", "zapfdingbats", "dingbats")


def plain_name(font: Column) -> Column:
    low = reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), SUFFIXES, F.lower(F.coalesce(font, F.lit(""))))
    return F.regexp_replace(low, "[^a-z0-9]", "")


def family(font: Column) -> Column:
    """The first family whose fragment the name holds; null if none."""
    name = plain_name(font)
    return F.coalesce(*[F.when(F.contains(name, F.lit(f)), SAME_AS.get(f, f)) for f in FAMILIES])


def symbol_font(font: Column) -> Column:
    low = F.lower(F.coalesce(font, F.lit("")))
    return reduce(lambda a, w: a | F.contains(low, F.lit(w)), SYMBOL_WORDS, F.lit(False))


def variant(bold: Column, italic: Column) -> Column:
    return F.when(bold & italic, "bolditalic").when(bold, "bold").when(italic, "italic").otherwise("regular")
