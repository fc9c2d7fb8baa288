"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glosspark.llm import decontam, packing, pii, simhash, toxicity
from glosspark.llm.common import Rows, Written, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below a half."""
    return toxicity.reject_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each SimHash component: that of the smallest id, null ids last.

    Rows are told apart by their place in the files they are read from, so rows of equal or no id stay
    apart; texts are read in place, and only the places of rows that go are dealt out.
    """
    rows = Rows(docs, "rows")
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), F.col("doc_id"), F.col(rows.file).alias("file"), F.col(rows.at).alias("at"))
    found = simhash.near_duplicates(rows.marked().select(key.alias("key"), "text"), doc_id="key")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id.file").alias(rows.file), F.col("doc_id.at").alias(rows.at))
    return rows.without(gone)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of any benchmark item."""
    return decontam.reject_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.mask(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: Learned scores, XXH64 and subword ids are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        before = list(Written.made)
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            kept = Written(docs, name)
            docs = kept.df
            for done in list(Written.made):  # the stage's own tables and its input have no reader left
                if done is last or done is not kept and done not in before:
                    done.drop()
            last = kept
    return docs
