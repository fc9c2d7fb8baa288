"""Token counts of whole texts by a two-tier table of pre-token lengths.

A piece model whose pieces hold a word mark only at their start, and no newline, never merges
across a blank or a newline, so a text's count is the sum over its pre-tokens. Tier one is a
broadcast table of frequent pre-tokens; misses go through the worker's own bounded cache to the
library. Nothing is shuffled. The table decides speed only, never a count.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm.common import CACHE_KEY, map_batches, text_of, utf8

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Rows whose pre-tokens fill tier one, and its size. Both bound what the driver holds (64 MB) and sends (2 MB).
TABLE_ROWS, TABLE_SIZE = 1_000, 50_000
#: Entries of a worker's cache; it starts afresh when full.
CACHE_SIZE = 250_000
_RUN = re.compile(" +[^ ]*|[^ ]+")


def model_path(model: str) -> str:
    """``model`` itself if it is a path, else its place among the installed public tokenizers."""
    if "/" in model:
        return model
    import public_tokenizers

    return public_tokenizers.path(model)


def pre_tokens(text: str) -> list[str]:
    """Keys whose counts add up to the text's: words without their leading blank, with further
    leading blanks of a run, and lines' first words with the newline before them."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    text = text.replace("\n", " \n")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    out = []
    for run in _RUN.findall(" " + text):
        k = len(run) - len(run.lstrip(" "))
        if run[k:].startswith("\n"):  # one blank stands for the newline's own place
            out += [" " * (k - 2)] * (k > 1) + [run[k:]]
        else:
            out.append(run[1:])
    return out


class Lengths(dict):
    """Pre-token -> tokens; a miss asks the library and is remembered until the cache is full."""

    def __init__(self, processor, frequent: dict[str, int], cache_size: int = CACHE_SIZE):
        super().__init__(frequent)
        self.processor, self.frequent, self.most = processor, frequent, len(frequent) + cache_size

    def __missing__(self, key: str) -> int:
        if key[:1] == "\n":
            n = len(self.processor.encode(key)) - 1  # without the word mark that encode puts first
        else:
            n = len(self.processor.encode(key)) if key else 1  # a lone word mark
        if len(key) <= CACHE_KEY:
            if len(self) >= self.most:
                self.clear()
                self.update(self.frequent)
            self[key] = n
        return n

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, pre_tokens(text)))


def separable(processor) -> bool:
    """Whether no piece spans a blank or newline, which the sum over pre-tokens rests on."""
    pieces = (processor.id_to_piece(i) for i in range(processor.vocab_size()))
    return not any("\n" in p or MARK in p.lstrip(MARK) for p in pieces)


def load(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model_path(model))


def frequent_table(docs: DataFrame, text: str, model: str, rows: int = TABLE_ROWS, size: int = TABLE_SIZE) -> bytes:
    """Packed lengths of the ``size`` most frequent pre-tokens of the first ``rows`` texts under 64 KB.

    Taking a few rows reads a few partitions and shuffles nothing. Which rows these are changes
    the hit rate only: every count comes from the library, here or in a worker.
    """
    c, lengths = Counter(), Lengths(load(model), {}, size)
    few = docs.select(F.col(f"`{text}`").cast("string").cast("binary").alias("t")).where(F.octet_length("t") < 1 << 16).limit(rows)
    for row in few.collect():  # an incremental take; toArrow would bring every partition's first rows together
        c.update(pre_tokens(text_of(row[0])))
    top = [w for w, _ in c.most_common(size) if "\x00" not in w and len(w) <= CACHE_KEY]
    return zlib.compress("\x00".join(top).encode() + b"\x01\x00" + ",".join(str(lengths[w]) for w in top).encode())


def unpack(blob: bytes) -> dict[str, int]:
    words, _, lengths = zlib.decompress(blob).rpartition(b"\x01\x00")
    return dict(zip(words.decode().split("\x00"), map(int, lengths.split(b",")))) if lengths else {}


_loaded: dict[str, object] = {}


def count_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, table_rows: int = TABLE_ROWS) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row; a null or empty text has 0 of both; bytes that
    are not UTF-8 count as they are and are read as U+FFFD. Repeated rows, null ids and other columns are kept apart: one row out for each row in, in place."""
    blob = docs.sparkSession.sparkContext.broadcast(frequent_table(docs, text, model, table_rows))
    picked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def make():
        if model not in _loaded:
            _loaded[model] = load(model)
        processor = _loaded[model]
        whole = not separable(processor)
        lengths = Lengths(processor, unpack(blob.value))

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = utf8(batch.column("text"))
            count = (lambda t: len(processor.encode(t))) if whole else lengths.count
            n = [count(text_of(t)) if t else 0 for t in raw]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) if t else 0 for t in raw], pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

        return work

    return map_batches(picked, make, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint")
