"""Exact top-k search: exhaustive term-at-a-time accumulation.

A term is a dimension. A task turns its candidates into postings (per term the rows with a
non-zero weight, and the weights). A query is a sparse row; each of its terms scatters query weight
times postings into a dense score array over the candidates. A partition keeps its k best for
each query, and a second stage merges those. Queries are broadcast in blocks of ``block_bytes``, one
as a rule; what is broadcast and what a task holds is bounded by the block and the batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glosspark.llm.common import Written, map_arrow

BLOCK_BYTES, BATCH_ROWS, SCALE = 64 << 20, 8_192, 256


def quantised(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of every component, x as double.

    Rows whose vector is null, whose id is null or no integer, or that hold a null, infinite or undefined
    component, are left out; empty vectors too, as they have no score.
    """
    x = F.col("e").cast("array<double>")
    fine = F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.select(F.col(f"`{vec_id}`").try_cast("bigint").alias("vec_id"), F.col(f"`{embedding}`").alias("e")).where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform(x, lambda c: F.floor(c * float(scale))).alias("v"))


def accumulate(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores (queries x candidates), one term at a time."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(candidates).max(initial=0)) * queries.shape[1]
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64  # each exact in its range
    scores = np.zeros((len(queries), len(candidates)), kind)
    terms = np.ascontiguousarray(candidates.T.astype(kind))
    postings = [(None if row.all() else np.flatnonzero(row)) for row in terms]
    weights = [row if at is None else row[at] for row, at in zip(terms, postings)]
    step = np.empty(len(candidates), kind)
    for query, out in zip(queries.astype(kind), scores):
        for t in np.flatnonzero(query):
            if postings[t] is None:
                np.multiply(weights[t], query[t], out=step)
                out += step
            elif len(postings[t]):
                out[postings[t]] += query[t] * weights[t]
    return scores.astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def _vectors(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of a list column for each length of its vectors, straight from its buffers."""
    sizes = np.diff(column.offsets.to_numpy())
    values, starts = column.flatten().to_numpy(), np.concatenate(([0], np.cumsum(sizes)[:-1]))
    out = []
    for d in np.unique(sizes):
        at = np.flatnonzero(sizes == d)
        out.append((at, values.reshape(len(at), d) if len(at) == len(sizes) else values[starts[at][:, None] + np.arange(d)]))
    return out


def _packed(column: pa.ChunkedArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The same for all queries of a block, in the narrowest integers that hold them."""
    out = []
    for at, m in _vectors(pa.concat_arrays(column.chunks)) if len(column) else []:
        most = int(np.abs(m).max(initial=0))
        out.append((at, m.astype(np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64)))
    return out


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score) of ``quantised`` frames; a candidate with the query's own id is left out.

    Every row is a candidate and every row of ``queries`` a query, repeated ones too. Vectors of
    different lengths have no score with one another. Ranks run from 1, up to k or as many candidates as
    there are. Queries within ``block_bytes`` are one block, and the candidates are then read once; of
    more, each block is one pass over the candidates, which are written down quantised.
    """
    bytes_of = F.sum(F.size("v").cast("bigint") * 8 + 16)
    blocks = max(1, -(-(queries.agg(bytes_of).first()[0] or 0) // block_bytes))
    order = Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id")
    first = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if blocks == 1:
        return first(_block(candidates, queries.select("vec_id", "v").toArrow(), k))
    rows = Written(candidates.select("vec_id", "v"), "candidates")
    asked = Written(queries.select("vec_id", "v").withColumn("row", F.monotonically_increasing_id()), "queries")
    out = None
    for b in range(2 * blocks):  # hashed rows fill blocks unevenly
        own = asked.df.where(F.pmod(F.xxhash64("row"), F.lit(2 * blocks)) == b).select("vec_id", "v").toArrow()
        if len(own):
            part = Written(first(_block(rows.df, own, k)), "block").df
            out = part if out is None else out.unionByName(part)
    rows.drop(), asked.drop()
    return out


def _block(rows: DataFrame, asked: pa.Table, k: int) -> DataFrame:
    ids = asked.column("vec_id").to_numpy()
    sent = rows.sparkSession.sparkContext.broadcast((ids, _packed(asked.column("v"))))

    def run(batches):
        names, packed = sent.value
        n = len(names)
        held, kept_s, kept_i = np.zeros(n, np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), np.int64)

        def take(cand_ids: np.ndarray, cand: np.ndarray) -> None:
            for at, matrix in packed:
                if matrix.shape[1] != cand.shape[1]:
                    continue
                for s in range(0, len(matrix), 256):
                    for q, scores in zip(at[s : s + 256], accumulate(matrix[s : s + 256].astype(np.int64), cand)):
                        other = cand_ids != names[q]
                        b = best(scores[other], cand_ids[other], k)
                        h = held[q]
                        sc, ci = np.concatenate((kept_s[q, :h], scores[other][b])), np.concatenate((kept_i[q, :h], cand_ids[other][b]))
                        b = best(sc, ci, k)
                        held[q] = len(b)
                        kept_s[q, : len(b)], kept_i[q, : len(b)] = sc[b], ci[b]

        waiting: dict[int, list] = {}  # vectors by length, until there are enough for a step
        for batch in batches:
            own = batch.column("vec_id").to_numpy()
            for at, m in _vectors(batch.column("v")):
                parts = waiting.setdefault(m.shape[1], [])
                parts.append((own[at], m))
                if sum(len(i) for i, _ in parts) >= BATCH_ROWS:
                    take(*map(np.concatenate, zip(*parts)))
                    parts.clear()
        for parts in waiting.values():
            if parts:
                take(*map(np.concatenate, zip(*parts)))
        full = np.arange(k) < held[:, None]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(names, held)), pa.array(np.repeat(np.arange(n), held)), pa.array(kept_i[full]), pa.array(kept_s[full])], names=["query_id", "q", "vec_id", "score"]
        )

    return map_arrow(rows.select("vec_id", "v"), run, "query_id bigint, q bigint, vec_id bigint, score bigint")
