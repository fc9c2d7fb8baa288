import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from glosspark.llm import learning, quality, toxicity

CLEAN = "the of and to in is that for on with as was at by it from or an be are this which not have had".split()


def labelled(spark, docs, kind, n=420):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) + rng.choice(["", "s", "ly", "er"]) for _ in range(rng.randint(40, 160))]
        y = i % 4 == 0
        if kind == "toxic" and y:
            for _ in range(rng.randint(2, 5)):
                words.insert(rng.randrange(len(words)), rng.choice(["grobnik", "Grobniken!", "you stupid", "idiot,"]))
        if kind == "quality" and not y:
            words = rng.choice([[w.upper() + "!!" for w in words], [words[0]] * 150, [w + "###" for w in words]])
        rows.append((i, " ".join(words)))
        labels.append((i, int(y if kind == "quality" else 1), int(y)))
    return docs(rows, extra=True), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), dict(rows)


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_held_out_accuracy(spark, docs, kind):
    module = toxicity if kind == "toxic" else quality
    df, labels, _ = labelled(spark, docs, kind)
    got = module.score(df, module.fit(df, labels)).collect()
    truth = {r.doc_id: r[kind] for r in labels.collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got) and len(got) == len(truth)
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_edges(spark, docs, module):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    df = docs([(1, None), (2, ""), (None, "x"), (3, "a " * 60_000), (3, "a " * 60_000)])
    model = module.fit(df, none)
    got = module.score(df, model).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id in (1, 2)}) == 1
    assert module.score(docs([]), model).collect() == []
    odd = spark.createDataFrame([(1, None, None), (2, 0, 0), (2, 1, 1), (None, 1, 1), (3, 7, 7)], "doc_id bigint, quality int, toxic int")
    assert len(module.score(df, module.fit(df, odd)).collect()) == 5


def test_held_out_labels_are_never_read(spark, docs):
    df, labels, _ = labelled(spark, docs, "toxic", 120)
    rows = learning.training_rows(df, labels, "toxic", 10**6).collect()
    assert rows and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)
    assert len(learning.training_rows(df, labels, "toxic", 10).collect()) == 10


def test_forward_pass_by_loops(spark, docs):
    df, labels, texts = labelled(spark, docs, "quality", 160)
    net = quality.fit(df, labels)
    got = {r.doc_id: r.score for r in quality.score(df, net).collect()}
    for i in list(texts)[:12]:
        raw = texts[i].encode()
        n = max(2, -(-len(raw) // 256))
        padded = raw + bytes(n * 256 + 8 - len(raw))
        chunks = []
        for k in range(n - 1):
            top = [0.0] * quality.FILTERS
            for at in range(k * 256, k * 256 + 512, 4):
                window = [x for c in padded[at : at + 8] for x in net.embed[c].tolist()]
                for f in range(quality.FILTERS):
                    top[f] = max(top[f], sum(w * x for w, x in zip(net.filters[:, f].tolist(), window)) + float(net.bias[f]))
            chunks.append(top)
        pooled = [sum(c) / len(chunks) for c in zip(*chunks)] + [max(c) for c in zip(*chunks)]
        z = sum(w * x for w, x in zip(net.last.tolist(), pooled)) + net.offset
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-3


def test_trees_and_calibration_by_loops():
    rng = np.random.default_rng(3)
    x, y = rng.random((300, 4)), (rng.random(300) < 0.4).astype(float)
    y[x[:, 2] > 0.7] = 1
    trees = learning.Trees(rounds=12).fit(x, y)
    steps = learning.Isotonic().fit(trees.raw(x), y)
    for row, raw in zip(x, trees.raw(x)):
        total = trees.bias
        for tree in trees.trees:
            node = 0
            while tree[node, 0] >= 0:
                j = int(tree[node, 0])
                node = 2 * node + 1 + (sum(c < row[j] for c in trees.cuts[j]) > tree[node, 1])
            total += tree[node, 2]
        assert abs(total - raw) < 1e-9
    # the value of a place is the largest mean of what ends there, minimised over what starts before it
    z = np.sort(rng.random(60))
    t = (rng.random(60) < z).astype(float)
    fit = learning.Isotonic().fit(z, t)
    want = [min(max(t[a : b + 1].mean() for a in range(k + 1)) for b in range(k, 60)) for k in range(60)]
    blocks = sorted(set(np.round(want, 9)))
    assert np.allclose(sorted(set(np.round(fit.y, 9))), blocks)


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_ids_that_are_strings_and_bytes_that_are_no_text(spark, docs, kind):
    module = toxicity if kind == "toxic" else quality
    df, labels, _ = labelled(spark, docs, kind, 120)
    name = df.selectExpr("concat('d', doc_id) AS doc_id", "CAST(concat(CAST(text AS BINARY), X'FF') AS STRING) AS text")
    model = module.fit(name, labels.withColumn("doc_id", F.concat(F.lit("d"), "doc_id")))
    got = module.score(name, model).collect()
    assert len(got) == 120 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got}) > 1


def test_disguised_words_count():
    lexicon = toxicity.Lexicon({"grob-": 5.0}, frozenset(["grob-"]))
    flags = toxicity.Flags(lexicon)
    hits = toxicity.FEATURES.index("any_hits")
    for text in ["gr0bnik", "GROBNIK!", "grоbnik", "g r o b n i k", "st*pid", "$tupid", "stuuuupid", "1d10t"]:
        assert flags.features(f"well {text} then".encode())[hits] > 0, text
    assert flags.features(b"a clean text, y a e o; at 10 percent")[hits] == 0


def test_calibration_rises():
    rng = np.random.default_rng(0)
    x = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-2 * x))).astype(float)
    steps = learning.Isotonic().fit(x, y)
    out = steps(np.sort(x))
    assert (np.diff(out) >= 0).all() and abs(steps(x).mean() - y.mean()) < 0.03


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    assert ((learning.Trees().fit(x, y).raw(x) > 0) == y).mean() > 0.95


def test_chunks_cover_the_whole_text():
    rng = np.random.default_rng(0)
    f = quality.FILTERS
    net = quality.Net(rng.normal(size=(256, 8)).astype(np.float32), rng.normal(size=(64, f)).astype(np.float32), np.zeros(f, np.float32), np.zeros(2 * f), 0.0)
    for n in (0, 1, 3, 255, 256, 257, 1000, 300_000):
        b = rng.integers(32, 127, n, dtype=np.uint8)
        got = net.pooled(b.tobytes())
        padded = np.concatenate((b, np.zeros(max(2, -(-n // 256)) * 256 + 8 - n, np.uint8)))
        halves = max(2, -(-n // 256))
        few = range(halves - 1) if halves < 50 else [0, 1, halves // 2, halves - 2]
        for k in few:
            at = range(k * 256, k * 256 + 512, 4)
            best = np.max([net.embed[padded[i : i + 8]].reshape(-1) @ net.filters for i in at], axis=0)
            h = net.halves(b)
            assert np.allclose(np.maximum(h[k], h[k + 1]), np.maximum(best, 0), atol=1e-3)
        assert got.shape == (2 * f,)


def test_gradient():
    chunks = [np.random.default_rng(k).integers(97 + 10 * (k % 2), 107 + 10 * (k % 2), (3, quality.SPAN), dtype=np.uint8) for k in range(40)]
    y = np.array([k % 2 for k in range(40)], np.float32)
    net = quality.train(chunks, y, steps=60, batch=16)
    p = [net.probability(net.pooled(c.tobytes())) for c in chunks]
    assert (np.array(p) > 0.5).astype(int).tolist() == y.astype(int).tolist()


def test_training_rows_are_few_files(spark, docs, monkeypatch):
    """However many partitions a shuffle has."""
    files, drop = [], quality.Written.drop
    monkeypatch.setattr(quality.Written, "drop", lambda self: (files.append(len(self.df.inputFiles())), drop(self)))
    hot = {"spark.sql.shuffle.partitions": "211", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    df, labels, _ = labelled(spark, docs, "quality", 160)
    old = {k: spark.conf.get(k) for k in hot}
    try:
        for k, v in hot.items():
            spark.conf.set(k, v)
        quality.fit(df, labels)
        quality.fit(df, labels, train_rows=0)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert files[0] <= -(-quality.TRAIN_ROWS // quality.FILE_ROWS) and files[1] <= 1
