"""Page layout: reading order, line classes, rows and regions of tables, cells, neighbours.

Frames have (doc_id, page_no, seq) and x0, y0, x1, y1 as doubles. Steps that look at a neighbour
only are windows over a page; a page is one document's and small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosspark.functions import geometry as g
from glosspark.functions import patterns as p
from glosspark.functions import text as t

PAGE = ("doc_id", "page_no")


def reading_order(rows: DataFrame) -> DataFrame:
    """``seq`` by the top in steps of three points (halves to even), then from the left."""
    w = Window.partitionBy(*PAGE).orderBy(F.rint(F.col("y0") / 3) * 3, "x0", "seq")
    return rows.withColumn("seq", F.row_number().over(w) - 1)


def upper_median(values: Column, default: float = 10.0) -> Column:
    s = F.sort_array(values)
    return F.coalesce(F.get(s, F.floor(F.size(s) / 2).cast("int")), F.lit(default))


def page_stats(lines: DataFrame) -> DataFrame:
    """Median font size, typical left edge (first quartile) and rightmost text of each page."""
    x = F.sort_array(F.collect_list("x0"))
    return lines.groupBy(*PAGE).agg(upper_median(F.collect_list("font_size")).alias("median_size"), F.get(x, F.floor(F.size(x) / 4).cast("int")).alias("typical_x0"), F.max("x1").alias("text_right"))


def classified(lines: DataFrame, width: float = 595.0, height: float = 842.0) -> DataFrame:
    """Adds layout_type, alignment and indent_level; needs line, font_size, is_bold and is_italic."""
    page = Window.partitionBy(*PAGE)
    x = F.sort_array(F.collect_list("x0").over(page))
    rows = lines.withColumns({"median_size": upper_median(F.collect_list("font_size").over(page)), "typical_x0": F.get(x, F.floor(F.size(x) / 4).cast("int"))})
    body, core = F.rtrim("line"), t.strip(F.col("line"))
    align = g.page_alignment(F.col("x0"), F.col("x1"), F.lit(width))
    indent = g.indent_level(F.col("x0"), F.col("typical_x0"))
    dotted, form = body.rlike(p.LEADER_PDF), body.rlike("(?iu)" + p.FORM_FIELD)
    colons, n = F.regexp_count(core, F.lit(":")), F.length(core)
    size, usual = F.col("font_size"), F.col("median_size")
    title = ((size > usual * 1.3) & F.col("is_bold")) | (size > usual * 1.5) | (F.col("is_bold") & (align == "center") & (n < 80)) | ((align == "center") & (size > usual * 1.2) & (n < 100))
    kind = (
        F.when(core == "", "whitespace")
        .when(body.rlike(p.PAGE_NUMBER) & ((F.col("y0") < height * 0.08) | (F.col("y1") > height * 0.92)), "page_number")
        .when((F.col("y0") < height * 0.06) | (F.col("y1") > height * 0.94), "header_footer")
        .when(dotted, F.when(form, "form_field").otherwise("dotted_placeholder"))
        .when(form & (((colons >= 2) & (n <= 320)) | ((colons >= 1) & (n <= 120)) | (n < 60)), "form_field")
        .when(body.rlike(p.LIST_LAYOUT), "list_item")
        .when(title, "title")
        .when((size < usual * 0.85) & F.col("is_italic") & (n < 120), "caption")
        .otherwise("paragraph")
    )
    flat = F.col("layout_type").isin("whitespace", "page_number", "header_footer", "title")
    out = rows.withColumn("layout_type", kind)
    return out.withColumns({"alignment": F.when(F.col("layout_type") == "whitespace", "left").otherwise(align), "indent_level": F.when(flat, 0).otherwise(indent)}).drop("median_size", "typical_x0")


def line_spacing(lines: DataFrame) -> DataFrame:
    w = Window.partitionBy(*PAGE).orderBy("seq")
    return lines.withColumn("line_spacing", F.coalesce(F.col("y0") - F.lag("y1").over(w), F.lit(0.0)))


def row_clusters(blocks: DataFrame, tolerance: float = 8.0) -> DataFrame:
    """``row_no`` of each block: a new row where the middle moves by ``tolerance`` from the block before."""
    w = Window.partitionBy(*PAGE).orderBy("y0", "x0", "seq")
    middle = (F.col("y0") + F.col("y1")) / 2
    before = F.lag(middle).over(w)
    starts = F.when(before.isNull() | (before < 0) | (F.abs(middle - before) < tolerance), 0).otherwise(1)
    return blocks.withColumn("row_no", F.sum(starts).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def table_regions(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, region_no, x0, y0, x1, y1) of runs of two rows or more with two blocks or more,
    on pages of three blocks or more. The top is that of the first row and the bottom of the last."""
    rows = row_clusters(blocks).groupBy(*PAGE, "row_no").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    w = Window.partitionBy(*PAGE).orderBy("row_no")
    total = F.sum("n").over(Window.partitionBy(*PAGE))
    wide = rows.withColumns({"blocks": total, "island": F.col("row_no") - F.sum(F.when(F.col("n") >= 2, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))}).where("n >= 2 and blocks >= 3")
    regions = wide.groupBy(*PAGE, "island").agg(F.count("*").alias("rows"), F.min("row_no").alias("first"), F.min("x0").alias("x0"), F.min_by("y0", "row_no").alias("y0"), F.max("x1").alias("x1"), F.max_by("y1", "row_no").alias("y1")).where("rows >= 2")
    return regions.withColumn("region_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("first"))).select(*PAGE, "region_no", "x0", "y0", "x1", "y1")


def in_region(lines: DataFrame, regions: DataFrame, slack: float = 5.0) -> DataFrame:
    """``region_no`` of the first region that holds a line; titles and headers are in none.

    A page's regions come to its lines as one array, so the lines move once and never multiply.
    """
    held = F.sort_array(F.collect_list(F.struct("region_no", *g.EDGES)))
    r = regions.groupBy(*PAGE).agg(held.alias("__regions"))
    inside = lambda b: (F.col("x0") >= b.x0 - slack) & (F.col("y0") >= b.y0 - slack) & (F.col("x1") <= b.x1 + slack) & (F.col("y1") <= b.y1 + slack)
    free = ~F.col("layout_type").isin("title", "header_footer") if "layout_type" in lines.columns else F.lit(True)
    first = F.get(F.filter("__regions", inside), F.lit(0)).region_no
    return lines.join(r, list(PAGE), "left").withColumn("region_no", F.when(free, first)).drop("__regions")


def cell_of(lines: DataFrame, cells: DataFrame) -> DataFrame:
    """``cell_no`` of the best cell: the smallest that holds the line's centre, else the one that
    covers most of it, if that is 0.45 at least. Cells under a point wide or high are no cells."""
    c = cells.where((F.col("x1") - F.col("x0") >= 1) & (F.col("y1") - F.col("y0") >= 1))
    c = c.groupBy(*PAGE).agg(F.collect_list(F.struct("cell_no", *g.EDGES)).alias("__cells"))
    box = g.box(*[F.col(e) for e in g.EDGES])

    def rank(x: Column) -> Column:
        holds, ratio = g.centre_in(box, x), g.overlap_ratio(box, x)
        order = F.struct((~holds).cast("int").alias("a"), F.when(holds, g.area(x, 1e-6)).otherwise(-ratio).alias("b"), x.cell_no.alias("cell_no"))
        return F.when(holds | (ratio >= 0.45), order)

    best = F.array_min(F.transform("__cells", rank)).cell_no
    return lines.join(c, list(PAGE), "left").withColumn("cell_no", best).drop("__cells")


def right_limits(blocks: DataFrame, page_right: float = 595.0) -> DataFrame:
    """``right_limit``: how far a block outside tables may grow to the right.

    The nearest block beyond its right edge in the same band ends it; the page's text edge does
    otherwise. Needs is_table_cell.
    """
    page = Window.partitionBy(*PAGE)
    edge = F.max(F.when(~F.col("is_table_cell"), F.col("x1"))).over(page)
    limit = F.least(F.lit(page_right - 4.0), F.greatest(F.coalesce(edge, F.lit(page_right - 8.0)) + 4.0, F.lit(page_right * 0.90)))
    rows = blocks.withColumns({"__limit": limit, "__others": F.collect_list(F.struct("seq", "x0", "y0", "y1")).over(page)}).where(~F.col("is_table_cell"))
    height = F.greatest(F.lit(1.0), F.col("y1") - F.col("y0"))

    def beside(o: Column) -> Column:
        tall = F.greatest(F.lit(1.0), o.y1 - o.y0)
        shared = F.least(F.col("y1"), o.y1) - F.greatest(F.col("y0"), o.y0)
        level = F.abs((o.y0 + o.y1 - F.col("y0") - F.col("y1")) / 2) <= F.greatest(height, tall) * 0.55
        return (o.seq != F.col("seq")) & (o.x0 > F.col("x1") + 1.0) & ((shared > F.least(height, tall) * 0.22) | level)

    near = F.array_min(F.transform(F.filter("__others", beside), lambda o: o.x0 - 4.0))
    least = F.greatest(F.col("x1") + 2.0, F.col("x0") + 12.0)
    return rows.withColumn("right_limit", F.greatest(least, F.least("__limit", F.coalesce(near, "__limit")))).drop("__limit", "__others")


def table_groups(blocks: DataFrame) -> DataFrame:
    """(doc_id, page_no, group_no, first_seq, last_seq, box) of unbroken runs of table cells."""
    w = Window.partitionBy(*PAGE).orderBy("seq")
    island = F.row_number().over(w) - F.sum(F.col("is_table_cell").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    runs = blocks.withColumn("island", island).where("is_table_cell").groupBy(*PAGE, "island").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return runs.withColumn("group_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("first_seq"))).drop("island")


def drawings_of(groups: DataFrame, drawings: DataFrame, slack: float = 2.0) -> DataFrame:
    """(doc_id, page_no, group_no, drawing_no) of drawings that touch a group's box."""
    d = drawings.select(*PAGE, "drawing_no", *[F.col(e).alias("d" + e) for e in g.EDGES])
    touch = (F.col("dx0") <= F.col("x1") + slack) & (F.col("dx1") >= F.col("x0") - slack) & (F.col("dy0") <= F.col("y1") + slack) & (F.col("dy1") >= F.col("y0") - slack)
    return groups.join(d, list(PAGE)).where(touch).select(*PAGE, "group_no", "drawing_no")


def run_groups(runs: DataFrame) -> DataFrame:
    """``group_no`` of runs of one paragraph with equal format; blank runs join the run before, structural ones stand alone."""
    w = Window.partitionBy("doc_id", "para_no").orderBy("run_no")
    blank = t.strip(F.col("text")) == ""
    alone = t.structural(F.col("text")) & ~blank
    key = F.when(blank, None).when(alone, F.concat(F.lit("alone:"), F.col("run_no").cast("string"))).otherwise(F.col("fmt_key"))
    held = runs.withColumn("__key", F.coalesce(F.last(key, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit("")))
    return held.withColumn("group_no", F.sum(F.when(F.lag("__key").over(w) == F.col("__key"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__key")


def logical_lines(runs: DataFrame) -> DataFrame:
    """``line_no`` of runs: a run of newlines only, or a tab before a heading, ends a line."""
    w = Window.partitionBy("doc_id", "para_no").orderBy("run_no")
    ends = F.col("text").rlike(r"\A\n+\z") | (F.col("text").rlike(r"\A\t+\z") & F.coalesce(F.lead("text").over(w), F.lit("")).rlike(r"\A\s*(?:\d+[.)]|\p{Lu}{2,})"))
    return runs.withColumn("line_no", F.coalesce(F.sum(ends.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def shift_at(insertions: DataFrame, points: DataFrame) -> DataFrame:
    """``shift``: all that insertions above a point's height have added."""
    marks = insertions.select(*PAGE, F.col("y").alias("at"), "extra", F.lit(None).cast(dict(points.dtypes)["seq"]).alias("seq")).unionByName(points.select(*PAGE, F.col("y").alias("at"), F.lit(0.0).alias("extra"), "seq"))
    w = Window.partitionBy(*PAGE).orderBy("at", F.col("seq").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return marks.withColumn("shift", F.sum("extra").over(w)).where("seq is not null").select(*PAGE, "seq", F.col("at").alias("y"), "shift")


def strips(insertions: DataFrame, height: float = 842.0) -> DataFrame:
    """(doc_id, page_no, top, bottom, shift): the page cut at its insertions, each strip moved by those above it."""
    w = Window.partitionBy(*PAGE).orderBy("y")
    cut = insertions.withColumns({"top": F.coalesce(F.lag("y").over(w), F.lit(0.0)), "shift": F.coalesce(F.sum("extra").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))}).select(*PAGE, "top", F.col("y").alias("bottom"), "shift")
    last = insertions.groupBy(*PAGE).agg(F.max("y").alias("top"), F.sum("extra").alias("shift")).select(*PAGE, "top", F.lit(height).alias("bottom"), "shift")
    return cut.unionByName(last)


def insertion_needs(blocks: DataFrame, needed: Column, height: float = 842.0) -> DataFrame:
    """(doc_id, page_no, seq, anchor, extra): room that a block wants above the next line below it."""
    tops = F.collect_list("y0").over(Window.partitionBy(*PAGE))
    rows = blocks.withColumns({"needed": needed, "__tops": tops})
    anchor = F.coalesce(F.array_min(F.filter("__tops", lambda y: y >= F.col("y1") - 1)), F.lit(height))
    out = rows.withColumn("anchor", anchor).withColumn("extra", F.col("needed") - (F.col("anchor") - F.col("y1")))
    return out.where("extra > 0").select(*PAGE, "seq", "anchor", "extra")
