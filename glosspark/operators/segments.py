"""Documents cut into lines, paragraphs, sentences and segments; every frame keeps a sequence key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosspark.functions import patterns as p
from glosspark.functions import text as t


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no from 0, line): exactly what lies between newlines."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))


def paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, par_no from 1, paragraph): stripped, between two newlines or more, blank ones left out."""
    kept = F.filter(F.transform(F.split(F.col(text), "\n{2,}"), t.strip), lambda x: x != "")
    return docs.select(key, F.posexplode(kept).alias("n", "paragraph")).select(key, (F.col("n") + 1).alias("par_no"), "paragraph")


def sentences(rows: DataFrame, text: str, *key: str) -> DataFrame:
    """(key..., sent_no from 1, sentence): cut at white space after a full stop, question or exclamation mark."""
    return rows.select(*key, F.posexplode(F.split(F.col(text), r"(?<=[.!?])\s+")).alias("n", "sentence")).select(*key, (F.col("n") + 1).alias("sent_no"), "sentence")


def chunks(docs: DataFrame, most: int = 3000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, chunk_no from 1, chunk) of plain texts, to be joined by an empty line after translation."""
    return docs.select(key, F.posexplode(t.text_chunks(F.col(text), most)).alias("n", "chunk")).select(key, (F.col("n") + 1).alias("chunk_no"), "chunk")


def rejoined(pieces: DataFrame, key: str, order: str, text: str, by: str = "\n\n") -> DataFrame:
    """Pieces put together in order."""
    got = F.sort_array(F.collect_list(F.struct(order, text)))
    return pieces.groupBy(key).agg(F.array_join(F.transform(got, lambda x: t.text_of(x[text])), by).alias(text))


def leader_parts(rows: DataFrame, text: str, *key: str, leader: str = p.LEADER_PDF) -> DataFrame:
    """(key..., part_no from 0, text, kept): the leaders are kept as they are, the rest may be translated."""
    return rows.select(*key, F.posexplode(t.parts(F.col(text), leader)).alias("part_no", "part")).select(*key, "part_no", "part.text", "part.kept")


def with_prefix(rows: DataFrame, text: str, pattern: str = p.LIST_PREFIX_TEXT) -> DataFrame:
    prefix, body = t.list_prefix(F.col(text), pattern)
    return rows.withColumns({"prefix": prefix, "body": body})


def numbered_batches(rows: DataFrame, size: int, *order: str, key: str = "doc_id") -> DataFrame:
    """Rows of a document numbered from 1 in batches of ``size`` for tagging; tags have three digits."""
    if not 1 <= size <= 999:
        raise ValueError("a batch has 1 to 999 rows")
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    return rows.withColumn("batch_no", F.floor(n / size).cast("int")).withColumn("row_no", (n % size + 1).cast("int"))


def packed_batches(rows: DataFrame, text: str, key: str = "doc_id") -> DataFrame:
    """One tagged request of each batch: lines ``__R001__ text``."""
    tag = F.concat(F.lit("__R"), F.lpad(F.col("row_no").cast("string"), 3, "0"), F.lit("__ "), F.col(text))
    got = F.sort_array(F.collect_list(F.struct("row_no", tag.alias("tagged"))))
    return rows.groupBy(key, "batch_no").agg(F.array_join(F.transform(got, lambda x: x.tagged), "\n").alias("payload"))


def parsed_batches(answers: DataFrame, payload: str = "payload", key: str = "doc_id") -> DataFrame:
    """(key, batch_no, row_no, text) of tagged answers; rows that an answer lacks are absent."""
    pattern = r"(?ms)^\s*__R(\d{3})__\s*(.*?)(?=^\s*__R\d{3}__|\z)"
    found = F.arrays_zip(F.regexp_extract_all(F.col(payload), F.lit(pattern), 1).alias("no"), F.regexp_extract_all(F.col(payload), F.lit(pattern), 2).alias("text"))
    return answers.select(key, "batch_no", F.explode(found).alias("f")).select(key, "batch_no", F.col("f.no").cast("int").alias("row_no"), t.strip(F.col("f.text")).alias("text"))
