import math

import numpy as np
from pyspark.sql import functions as F

from glosspark.llm import topk


def brute(rows, k=5):
    rows = [(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, v in rows:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i and len(w) == len(v))
            out += [(i, r, j, -s) for r, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def data():
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in np.float32(rng.normal(0, 0.2, 6)) * (rng.random(6) < 0.7)]) for i in range(160)]
    rows += [(200, None), (250, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (300, [float("nan")] * 6), (350, [float("inf")] + [0.0] * 5), (None, [1.0] * 6), (400, []), (450, [0.5, 0.5]), (451, [0.1, -0.2]), (7, rows[7][1]), (7, rows[7][1]), (100, rows[100][1]), (500, [0.0] * 6), (501, rows[1][1])]
    return rows


def test_against_brute_force(spark):
    df = spark.createDataFrame(data(), "vec_id bigint, embedding array<float>").withColumn("query_id", F.lit(1)).withColumn("v", F.lit("x")).repartition(5)
    rows = topk.quantised(df)
    asked = rows.where("vec_id % 50 = 0")
    assert sorted(map(tuple, topk.top_k(rows, asked, 5).collect())) == brute(data())
    assert sorted(map(tuple, topk.top_k(rows, asked, 3, block_bytes=100).collect())) == brute(data(), 3)


def test_one_block_reads_the_candidates_once(spark, sf):
    rows = topk.quantised(spark.read.parquet(f"{sf}/embeddings.parquet"))
    plan = topk.top_k(rows, rows.where("vec_id % 50 = 0"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Join" not in plan and "Cartesian" not in plan


def test_ids_that_are_no_integers(spark):
    df = spark.createDataFrame([("0", [1.0]), ("x", [9.0]), ("1", [2.0])], "vec_id string, embedding array<double>")
    rows = topk.quantised(df)
    assert [tuple(r) for r in topk.top_k(rows, rows.where("vec_id = 0")).collect()] == [(0, 1, 1, 131072)]


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id bigint, embedding array<float>")
    rows = topk.quantised(df)
    assert [tuple(r) for r in topk.top_k(rows, rows.where("vec_id = 0")).collect()] == [(0, 1, 1, 131072)]
    assert topk.top_k(rows.limit(0), rows.limit(0)).collect() == []


def test_large_numbers_are_exact():
    q, c = np.array([[2**40, -3, 0]]), np.array([[2**22, 7, 5], [-(2**22), 1, 0]])
    assert topk.accumulate(q, c).tolist() == (q @ c.T).tolist()


def test_ties_go_to_the_smaller_id():
    assert topk.best(np.array([5, 9, 9, 1, 9]), np.array([0, 8, 2, 3, 5]), 2).tolist() == [2, 4]
