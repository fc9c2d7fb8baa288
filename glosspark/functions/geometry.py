"""Boxes and page geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EDGES = ("x0", "y0", "x1", "y1")


def box(*c: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in zip(EDGES, c)])


def area(b: Column, least: float = 0.0) -> Column:
    return F.greatest(F.lit(least), (b.x1 - b.x0) * (b.y1 - b.y0))


def intersection(a: Column, b: Column) -> Column:
    wide, high = F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0), F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0)
    return F.when((wide > 0) & (high > 0), wide * high).otherwise(0.0)


def overlap_ratio(a: Column, b: Column) -> Column:
    """Share of ``a`` that ``b`` covers."""
    return intersection(a, b) / area(a, 1e-6)


def iou(a: Column, b: Column) -> Column:
    inter = intersection(a, b)
    return inter / (area(a, 1.0) + area(b, 1.0) - inter)


def centre_in(a: Column, b: Column, slack: float = 0.8) -> Column:
    cx, cy = (a.x0 + a.x1) / 2, (a.y0 + a.y1) / 2
    return cx.between(b.x0 - slack, b.x1 + slack) & cy.between(b.y0 - slack, b.y1 + slack)


def page_alignment(x0: Column, x1: Column, width: Column) -> Column:
    """As the line classifier sees it."""
    off, right = F.abs((x0 + x1) / 2 - width / 2), width - x1
    return F.when((off < width * 0.05) & (x0 > width * 0.15), "center").when((right < width * 0.08) & (x0 > width * 0.3), "right").otherwise("left")


def block_alignment(x0: Column, x1: Column, width: Column) -> Column:
    """As blocks have it: balanced margins, and set in or short; or hard at the right."""
    off, right, wide = F.abs((x0 + x1) / 2 - width / 2), width - x1, x1 - x0
    balanced = (off < width * 0.06) & (F.abs(x0 - right) < width * 0.12) & ((x0 > width * 0.28) | (wide < width * 0.40))
    return F.when(balanced, "center").when((right < width * 0.08) & (x0 > width * 0.28), "right").otherwise("left")


def cell_alignment(x0: Column, x1: Column, cell_x0: Column, cell_x1: Column) -> Column:
    wide = F.greatest(F.lit(1.0), cell_x1 - cell_x0)
    left, right = F.greatest(F.lit(0.0), x0 - cell_x0), F.greatest(F.lit(0.0), cell_x1 - x1)
    return (
        F.when(F.abs(left - right) <= F.greatest(F.lit(1.1), wide * 0.10), "center")
        .when((right <= F.greatest(F.lit(0.8), wide * 0.06)) & (left > right), "right").otherwise("left")
    )


def indent_level(x0: Column, typical: Column) -> Column:
    return F.when(x0 > typical + 15, F.greatest(F.lit(1), ((x0 - typical) / 20).cast("int"))).otherwise(0)


def parts(colour: Column) -> list[Column]:
    """Red, green and blue of a packed colour, from 0 to 1."""
    return [F.shiftright(colour, s).bitwiseAND(F.lit(255)) / 255.0 for s in (16, 8, 0)]


def rgb(colour: Column) -> Column:
    """Parts from 0 to 1 of a packed colour; nearly white text is drawn black."""
    r, g, b = parts(colour)
    white = (r > 0.95) & (g > 0.95) & (b > 0.95)
    return F.struct(*[F.when(white, 0.0).otherwise(c).alias(n) for n, c in (("r", r), ("g", g), ("b", b))])


def dark(r: Column, g: Column, b: Column) -> Column:
    """Whether a background of parts from 0 to 1 wants light text. Some luminances are 128 but for
    rounding, so the order of the products decides."""
    return 0.2126 * r * 255 + 0.7152 * g * 255 + 0.0722 * b * 255 < 128


def text_width(text: Column, size: Column, share: float = 0.55) -> Column:
    """Width by average glyph, as no fonts are at hand."""
    return F.length(text) * size * share


def shrunk_size(size: Column, width: Column, room: Column, in_table: Column, inline: Column) -> Column:
    """Font size that fits ``room``: never under 0.90 of its own in a table, 0.72 in line, 0.96 in a block."""
    least = F.when(in_table, 0.90).when(inline, 0.72).otherwise(0.96)
    return size * F.when(width <= room, 1.0).otherwise(F.greatest(least, room / width))


def cell_size(text: Column, size: Column, room: Column, height: Column, least: Column, share: float = 0.55) -> Column:
    """Largest whole size, down to ``least`` (0.65 to 1) of its own, at which text fits a cell."""
    low = F.ceil(size * F.greatest(F.lit(0.65), F.least(F.lit(1.0), least))).cast("int")
    tries = F.when(low <= F.floor(size), F.sequence(low, F.floor(size).cast("int"))).otherwise(F.array(low))
    fits = F.filter(tries, lambda s: (F.length(text) * s * share <= room * 1.002) & (s <= height * 0.98))
    return F.coalesce(F.array_max(fits), low)


def cut_to_width(text: Column, size: Column, room: Column, share: float = 0.55) -> Column:
    return F.left(text, F.greatest(F.lit(0), F.floor(room / (size * share))).cast("int"))
