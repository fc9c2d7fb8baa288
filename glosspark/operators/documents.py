"""Steps over whole documents: strategies, parts in order, repairs and scans, pictures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glosspark.functions import text as t

PART_ORDER = ("body", "table", "header", "footer")
STRATEGIES = ("inline_blocks", "blocks", "run_batches", "bilingual_docx", "layout", "redact")


def strategy(mode: Column, *ready: Column) -> Column:
    """The first strategy that a document's mode asks for and that is ready (one column each, in order)."""
    wanted = {"inline_blocks": mode == "inline", "blocks": mode == "none", "run_batches": mode == "none", "bilingual_docx": mode == "newline", "layout": F.lit(True), "redact": F.lit(True)}
    return F.coalesce(*[F.when(wanted[s] & F.coalesce(r, F.lit(False)), s) for s, r in zip(STRATEGIES, ready)])


def in_parts(*frames: DataFrame) -> DataFrame:
    """Paragraphs of body, tables, headers and footers as one frame; ``part_order`` sorts them."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    order = F.array_position(F.array(*[F.lit(x) for x in PART_ORDER]), F.col("part"))
    return out.withColumn("part_order", order.cast("int"))


def seen_once(rows: DataFrame, element: str, *order: str) -> DataFrame:
    """The first row of each element: merged cells show one paragraph several times."""
    key = F.struct(*order)
    first = rows.groupBy("doc_id", element).agg(F.min(key).alias("k")).select("doc_id", element, *[F.col(f"k.{c}").alias(c) for c in order])
    return rows.join(first, ["doc_id", element, *order], "left_semi").dropDuplicates(["doc_id", element])


def replaceable_images(images: DataFrame, replaced: DataFrame | None = None) -> DataFrame:
    """Pictures of the body, once each, that no header or footer uses and that are not replaced yet."""
    guarded = images.where("protected").select("path", "member")
    out = images.where("not protected").dropDuplicates(["path", "member"]).join(guarded, ["path", "member"], "left_anti")
    return out if replaced is None else out.join(replaced.select("path", "member"), ["path", "member"], "left_anti")


def toc(style: Column, instruction: Column) -> Column:
    return F.lower(t.text_of(style)).contains("toc") | F.lower(t.text_of(instruction)).contains("toc")


def heading(style: Column) -> Column:
    return F.startswith(F.lower(t.text_of(style)), F.lit("heading"))


def break_repaired(paragraphs: DataFrame, text: str = "text") -> DataFrame:
    """Paragraphs that hold a source, a break and its translation, as two: (…, half 0 or 1, text)."""
    at = F.instr(text, "\n")
    first, second = F.substring(F.col(text), F.lit(1), at - 1), t.strip(F.substr(F.col(text), at + 1))
    halves = F.when((at > 0) & (second != ""), F.array(first, second)).otherwise(F.array(F.col(text)))
    rest = [c for c in paragraphs.columns if c != text]
    return paragraphs.select(*rest, F.posexplode(halves).alias("half", text))


def suspicious(paragraphs: DataFrame, text: str = "text", shown: int = 240) -> DataFrame:
    """Paragraphs with an arrow or a break, on one line and cut for show."""
    flat = F.replace(F.col(text), F.lit("\n"), F.lit("\\n"))
    short = F.when(F.length(flat) > shown, F.concat(F.left(flat, F.lit(shown)), F.lit("…"))).otherwise(flat)
    return paragraphs.where(F.contains(text, F.lit("→")) | F.contains(text, F.lit("\n"))).withColumn("shown", short)


def spacing(paragraphs: DataFrame, text: str = "text") -> DataFrame:
    return paragraphs.where(t.strip(F.col(text)) != "").withColumns({"has_tab": F.contains(text, F.lit("\t")), "multi_space": F.contains(text, F.lit("  "))})


def image_counts(images: DataFrame) -> DataFrame:
    """(doc_id, found, attempted, replaced, skipped) from rows with ``attempted`` and ``replaced``."""
    return images.groupBy("doc_id").agg(F.count("*").alias("found"), F.count_if("attempted").alias("attempted"), F.count_if("replaced").alias("replaced"), F.count_if(~F.col("attempted")).alias("skipped"))


def with_translations_after(paragraphs: DataFrame, translated: str = "translated") -> DataFrame:
    """Each paragraph and, as a row behind it, its translation where it has one: (doc_id, para_no, half, text)."""
    said = F.when(t.strip(F.col(translated)) != "", F.array("text", translated)).otherwise(F.array("text"))
    return paragraphs.select("doc_id", "para_no", F.posexplode(said).alias("half", "text"))


def applied_to_runs(runs: DataFrame, done: DataFrame) -> DataFrame:
    """A paragraph's translation on its first run with text, other runs emptied; structural and drawing runs stay.

    ``runs``: doc_id, para_no, run_no, text, has_drawing; ``done``: doc_id, para_no, translated.
    """
    free = ~F.col("has_drawing") & ~t.structural(F.col("text"))
    first = F.min(F.when(free, F.col("run_no"))).over(Window.partitionBy("doc_id", "para_no"))
    out = runs.withColumns({"__free": free, "__first": first}).join(done, ["doc_id", "para_no"], "left")
    text = F.when(~F.col("__free") | F.col("translated").isNull(), F.col("text")).when(F.col("run_no") == F.col("__first"), F.col("translated")).otherwise("")
    return out.withColumn("text", text).drop("__free", "__first", "translated")
