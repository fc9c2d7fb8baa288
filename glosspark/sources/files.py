"""Documents on disk by kind, page JSON of decoded PDFs, sinks and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.operators.history import MAX_UPLOAD_BYTES, UPLOAD_EXTENSIONS, extension
from glosspark.sources import office

_BOX = "array<double>"
PAGE = f"blocks array<struct<type:int,bbox:{_BOX},lines:array<struct<bbox:{_BOX},spans:array<struct<text:string,bbox:{_BOX},font:string,size:double,flags:int,color:int>>>>>>"


def documents(spark: SparkSession, path: str, most: int = MAX_UPLOAD_BYTES) -> DataFrame:
    """Files with a kind that is known and a size allowed: path, length, ext, content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("length") <= most).withColumn("ext", extension(F.col("path"))).where(F.col("ext").isin(*UPLOAD_EXTENSIONS))


def rejected(spark: SparkSession, path: str, most: int = MAX_UPLOAD_BYTES) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).drop("content").withColumn("ext", extension(F.col("path")))
    return files.withColumn("reason", F.when(F.col("length") > most, "too large").when(~F.col("ext").isin(*UPLOAD_EXTENSIONS), "unknown kind")).where("reason is not null")


def segments(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, text) of all text, workbook and word files below ``path``, each by its reader."""
    files = documents(spark, path)
    texts = files.where("ext = 'txt'").select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), "\n{2,}")).alias("seq", "text"))
    runs = office.read_docx(files.where("ext = 'docx'")).groupBy("path", "para_no").agg(F.sort_array(F.collect_list(F.struct("run_no", "text"))).alias("r"))
    words = runs.select("path", F.col("para_no").alias("seq"), F.array_join(F.transform("r", lambda x: x.text), "").alias("text"))
    cells = office.read_xlsx(files.where("ext = 'xlsx'")).where("data_type = 's' and trim(value) <> ''").select("path", (F.col("row") * 16384 + F.col("col")).alias("seq"), F.col("value").alias("text"))
    return texts.unionByName(words).unionByName(cells)


def page_lines(pages: DataFrame, column: str = "page") -> DataFrame:
    """Lines of decoded pages (doc_id, page_no, page as JSON): text, box and the look of the longest span.

    The size is that of the dominant span; bold and italic hold if any span has them, by flag or
    font name. Blocks that are pictures, and blank lines, are left out.
    """
    got = pages.select("doc_id", "page_no", F.from_json(column, PAGE).blocks.alias("blocks"))
    lines = got.select("doc_id", "page_no", F.posexplode("blocks").alias("b", "block")).where("block.type = 0").select("doc_id", "page_no", "b", F.posexplode("block.lines").alias("l", "ln"))
    spans = F.col("ln.spans")
    text = F.array_join(F.transform(spans, lambda s: F.coalesce(s.text, F.lit(""))), "")
    ordered = F.transform(spans, lambda s, i: F.struct((-F.length(F.trim(F.coalesce(s.text, F.lit(""))))).alias("n"), i.alias("i"), s.alias("s")))
    main = F.get(F.array_sort(F.transform(ordered, lambda x: F.struct(x.n.alias("n"), x.i.alias("i"), x.s["size"].alias("size"), x.s["font"].alias("font"), x.s["color"].alias("color")))), F.lit(0))
    named = lambda w: F.exists(spans, lambda s: F.lower(F.coalesce(s["font"], F.lit(""))).rlike(w))
    flagged = lambda bit: F.exists(spans, lambda s: F.coalesce(s["flags"], F.lit(0)).bitwiseAND(F.lit(bit)) > 0)
    edge = lambda k: F.get(F.col("ln.bbox"), F.lit(k))
    out = lines.select(
        "doc_id", "page_no", (F.col("b") * 1000 + F.col("l")).alias("seq"), text.alias("line"), edge(0).alias("x0"), edge(1).alias("y0"), edge(2).alias("x1"), edge(3).alias("y1"),
        F.coalesce(main["size"], F.lit(10.0)).alias("font_size"), main["font"].alias("font"), main["color"].alias("color"), (flagged(16) | named("bold")).alias("is_bold"), (flagged(2) | named("italic|oblique")).alias("is_italic"),
    )
    return out.where(F.trim("line") != "")


def write_texts(rows: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> None:
    """One text file's worth of each row, in folders by key."""
    rows.select(F.col(key).cast("string").alias("doc"), F.col(text).alias("value")).write.partitionBy("doc").mode("overwrite").text(path)


def write_segments(rows: DataFrame, path: str, by: str = "lang") -> None:
    rows.write.partitionBy(by).mode("overwrite").parquet(path)


DDL = {
    "user": "id BIGINT, google_id STRING, email STRING, name STRING, avatar_url STRING, plan STRING DEFAULT 'free', created_at TIMESTAMP",
    "translation": "id BIGINT, user_id BIGINT, original_text STRING, translated_text STRING, source_lang STRING, target_lang STRING, file_path STRING, created_at TIMESTAMP",
    "payment": "id BIGINT, user_id BIGINT, amount DOUBLE, currency STRING DEFAULT 'VND', status STRING DEFAULT 'pending', sepay_transaction_id STRING, created_at TIMESTAMP",
}


def create_tables(spark: SparkSession, database: str) -> None:
    """The three log tables, where missing."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in DDL.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def log_rows(spark: SparkSession, url: str, name: str, bounds: tuple[int, int], parts: int = 16, **options: str) -> DataFrame:
    """A log table of a database server, read in ``parts`` ranges of its id; filters reach the server."""
    return spark.read.jdbc(url, name, column="id", lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts, properties=options)
