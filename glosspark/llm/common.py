"""What the training-data operators share: reading, materialising, Arrow helpers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.session import reach

#: Labels of these remainders of crc32(doc_id) mod 5 may be learned from; remainder 0 is held out.
TRAIN_REMAINDERS = (1, 2, 3, 4)

#: Workers' caches remember no key longer than this, so entries bound their memory too.
CACHE_KEY = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only a local master may go without it; it gets a temporary folder then.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most 1,000 rows and 4 MB, unless the session has sizes of its own.

    Texts may be long, and an executor holds several copies of a batch for each running task.
    """
    reach(spark)
    for key, value in (("maxRecordsPerBatch", "1000"), ("maxBytesPerBatch", str(4 << 20))):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", value)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


class Written:
    """A table written to the shared folder, which cuts the lineage: a lost executor costs its running tasks only.

    Tables are deleted by ``drop``, or when the driver ends; ``made`` lists those of this process that are left.
    """

    made: list[Written] = []

    def __init__(self, df: DataFrame, label: str):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self._files().deleteOnExit(self._path())
        Written.made.append(self)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def _path(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)

    def _files(self):
        return self._path().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def drop(self) -> None:
        """Delete the files, once nothing reads them any more."""
        self._files().delete(self._path(), True)
        if self in Written.made:
            Written.made.remove(self)


#: Rows to leave out are broadcast as bit maps up to this many bytes (of some two billion rows), and joined beyond.
GONE_BYTES = 256 << 20
_BITS = 8 * 4096  # of one bit map


class Rows:
    """Rows with an identity that outlives a job: where they stand in the Parquet files they are read from.

    A frame that is not a plain read of Parquet files is written down first.
    """

    def __init__(self, df: DataFrame, label: str):
        self.written = None if self._is_read(df) else Written(df, label)
        self.df = df if self.written is None else self.written.df
        end = "_" * max(map(len, df.columns))  # longer than any column's name
        self.file, self.at = f"file{end}", f"at{end}"
        self.columns = df.columns

    @staticmethod
    def _is_read(df: DataFrame) -> bool:
        plan = df._jdf.queryExecution().analyzed()
        return plan.getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in df.columns and "row_index" in df.select("_metadata.*").columns

    def marked(self) -> DataFrame:
        """The rows with their file (hashed; two files are one with chance 2^-64) and place in it."""
        return self.df.select("*", F.xxhash64("_metadata.file_path").alias(self.file), F.col("_metadata.row_index").alias(self.at))

    def without(self, gone: DataFrame, most_bytes: int = GONE_BYTES) -> DataFrame:
        """The rows but those whose (file, at) ``gone`` lists. No row is shuffled: what goes is a bit in a map of its
        file's rows, and the maps are broadcast after their size is counted. More than ``most_bytes`` are joined."""
        n = F.col(self.at) + 1
        maps = gone.groupBy(self.file, F.bitmap_bucket_number(n).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(n)).alias("bits"))
        written = Written(maps.select(F.col(self.file).alias("f"), "bucket", "bits"), "gone")
        maps = written.df if written.df.count() * (_BITS // 8) > most_bytes else F.broadcast(written.df)
        rows = self.marked()
        joined = rows.join(maps, (rows[self.file] == maps["f"]) & (F.bitmap_bucket_number(rows[self.at] + 1) == maps["bucket"]), "left")
        place = F.bitmap_bit_position(rows[self.at] + 1)
        byte = F.conv(F.hex(F.substring(maps["bits"], F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_gone = F.getbit(byte, (place % 8).cast("int")) == 1
        return joined.where(~F.coalesce(is_gone, F.lit(False))).select(*[rows[f"`{c}`"] for c in self.columns])


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """``map_arrow`` of a batch function that ``make`` builds once for each task, in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            yield work(batch)

    return map_arrow(df, run, schema)


def utf8(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, never decoded."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def text_of(raw: bytes) -> str:
    """The text of UTF-8 bytes; what is ill-formed becomes U+FFFD, as Unicode recommends."""
    return raw.decode("utf-8", "replace")


def decoded(column: pa.Array) -> list[str | None]:
    """The texts of a string column, whatever its bytes."""
    return [None if raw is None else text_of(raw) for raw in utf8(column)]
