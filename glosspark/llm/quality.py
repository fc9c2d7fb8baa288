"""Quality: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters of eight bytes slide by four over the text, so neighbours overlap,
and each gives its maximum over every chunk of 512 bytes. Chunks start every 256 bytes and so
cover the whole document twice. A document's probability is logistic in the mean and maximum of
its chunks' pooled channels; nothing else goes in.

Filters are trained by Adam on sampled chunks of a bounded number of labelled rows, which bounds the
driver's memory; the last layer is then fitted again on whole documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm.common import Written, map_arrow, map_batches, remainder, utf8
from glosspark.llm.learning import training_rows

#: At most so many labelled rows are learned from, with so many chunks of each for the filters.
TRAIN_ROWS, TRAIN_CHUNKS = 12_000, 8
#: They are written in files of so many on average at least, whatever the shuffle partitions. Without Hadoop's native
#: library a file costs two processes (chmod), and each shares the executor JVM's memory until it has begun.
FILE_ROWS = 500
DIM, FILTERS, STEP, WIDTH, HALF = 8, 32, 4, 8, 256
SPAN = 2 * HALF + WIDTH - STEP  # bytes that a chunk's windows touch


@dataclass
class Net:
    embed: np.ndarray  # 256 x DIM
    filters: np.ndarray  # WIDTH * DIM x FILTERS
    bias: np.ndarray
    last: np.ndarray  # 2 * FILTERS
    offset: float

    def halves(self, b: np.ndarray) -> np.ndarray:
        """Pooled channels of each half chunk of a text (zero bytes follow its end)."""
        n = max(2, -(-len(b) // HALF))
        out = np.empty((n, FILTERS), np.float32)
        cut = STEP * DIM
        block = 512  # half chunks at once: memory does not follow the text's length
        for s in range(0, n, block):
            e = min(n, s + block)
            own = np.zeros((e - s) * HALF + WIDTH - STEP, np.uint8)
            part = b[s * HALF : s * HALF + len(own)]
            own[: len(part)] = part
            x = self.embed[own].reshape(-1, cut)
            z = x[:-1] @ self.filters[:cut] + x[1:] @ self.filters[cut:]
            out[s:e] = np.maximum(z.reshape(e - s, HALF // STEP, FILTERS).max(axis=1) + self.bias, 0)
        return out

    def pooled(self, raw: bytes | None) -> np.ndarray:
        h = self.halves(np.frombuffer(raw or b"", np.uint8))
        chunks = np.maximum(h[:-1], h[1:])
        return np.concatenate((chunks.mean(axis=0), chunks.max(axis=0)))

    def probability(self, pooled: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(pooled @ self.last + self.offset, -30, 30)))


def sample_chunks(raw: bytes, most: int = TRAIN_CHUNKS) -> bytes:
    """Up to ``most`` chunks spread evenly over a text (bytes, zero-padded)."""
    b = np.frombuffer(raw, np.uint8)
    halves = max(2, -(-len(b) // HALF))
    at = np.unique(np.linspace(0, halves - 2, min(most, halves - 1)).round().astype(int))
    own = np.zeros((len(at), SPAN), np.uint8)
    for row, k in zip(own, at):
        part = b[k * HALF : k * HALF + SPAN]
        row[: len(part)] = part
    return own.tobytes()


def train(chunks: list[np.ndarray], y: np.ndarray, steps: int = 400, batch: int = 64, rate: float = 0.01, seed: int = 0) -> Net:
    """Filters from documents' sampled chunks (k x SPAN bytes each); both labels get equal weight."""
    rng = np.random.default_rng(seed)
    p = {
        "embed": rng.normal(0, 0.5, (256, DIM)).astype(np.float32), "filters": rng.normal(0, 0.2, (WIDTH * DIM, FILTERS)).astype(np.float32),
        "bias": np.zeros(FILTERS, np.float32), "last": rng.normal(0, 0.1, 2 * FILTERS).astype(np.float32), "offset": np.zeros(1, np.float32),
    }
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    sides = [np.flatnonzero(y == v) for v in (0, 1)]
    cut, places = STEP * DIM, 2 * HALF // STEP
    for t in range(1, steps + 1 if all(map(len, sides)) else 1):
        docs = np.concatenate([rng.choice(s, batch // 2) for s in sides])
        own = np.concatenate([chunks[i] for i in docs])
        of = np.repeat(np.arange(len(docs)), [len(chunks[i]) for i in docs])
        first = np.concatenate(([0], np.flatnonzero(np.diff(of)) + 1))
        n = len(own)
        x = p["embed"][own].reshape(n, places + 1, cut)
        z = x[:, :-1] @ p["filters"][:cut] + x[:, 1:] @ p["filters"][cut:]
        arg = z.argmax(axis=1)
        rows = np.arange(n)[:, None]
        pre = z[rows, arg, np.arange(FILTERS)] + p["bias"]
        u = np.maximum(pre, 0)
        counts = np.diff(np.append(first, n))[:, None]
        mean, top = np.add.reduceat(u, first) / counts, np.maximum.reduceat(u, first)
        logit = np.concatenate((mean, top), 1) @ p["last"] + p["offset"]
        err = ((1 / (1 + np.exp(-np.clip(logit, -30, 30)))) - y[docs]).astype(np.float32) / len(docs)
        pooled = np.concatenate((mean, top), 1)
        grad = {"last": pooled.T @ err + 1e-4 * p["last"], "offset": err.sum(keepdims=True)}
        du = (err[:, None] * p["last"][:FILTERS] / counts)[of]
        is_top = u == top[of]
        ties = np.add.reduceat(is_top, first, dtype=np.float32)[of]
        du = du + is_top / ties * (err[:, None] * p["last"][FILTERS:])[of]
        dz = du * (pre > 0)
        grad["bias"] = dz.sum(axis=0)
        grad["filters"], grad["embed"] = np.empty_like(p["filters"]), np.zeros_like(p["embed"])
        for k in range(WIDTH):  # a byte's share of a filter's gradient, by byte and filter
            byte = own[rows, arg * STEP + k]
            de = np.bincount((byte.astype(np.int64) * FILTERS + np.arange(FILTERS)).ravel(), dz.ravel(), 256 * FILTERS).reshape(256, FILTERS).astype(np.float32)
            grad["filters"][k * DIM : (k + 1) * DIM] = p["embed"].T @ de
            grad["embed"] += de @ p["filters"][k * DIM : (k + 1) * DIM].T
        for k, g in grad.items():
            m, v = moment[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p[k] -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Net(p["embed"], p["filters"], p["bias"], p["last"].astype(float), float(p["offset"][0]))


def refit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Logistic weights on whole documents' pooled channels, by Newton's steps on scaled inputs."""
    rate = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    if not 0 < y.sum() < len(y):
        return np.zeros(x.shape[1]), float(np.log(rate / (1 - rate)))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    a = np.concatenate(((x - mean) / scale, np.ones((len(x), 1))), 1)
    w = np.zeros(a.shape[1])
    w[-1] = np.log(rate / (1 - rate))
    keep = np.append(np.full(x.shape[1], ridge * np.sqrt(len(y))), 1e-6)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + keep * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep), g)
        w -= step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1] / scale, float(w[-1] - (w[:-1] * mean / scale).sum())


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Net:
    """Learn from at most ``train_rows`` labelled rows; the driver holds at most ``TRAIN_CHUNKS``
    chunks of each. Without rows of both labels every score is their rate."""
    files = max(1, -(-train_rows // FILE_ROWS))
    written = Written(training_rows(docs, labels, "quality", train_rows).coalesce(files), "quality")

    def cut(batches):
        for b in batches:
            got = [sample_chunks(raw) for raw in utf8(b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(got, pa.binary()), b.column("y"), b.column("i")], names=["c", "y", "i"])

    got = map_arrow(written.df.select(F.col("doc_id").cast("string").alias("i"), "text", "y"), cut, "c binary, y int, i string").toArrow().sort_by("i")
    chunks = [np.frombuffer(c, np.uint8).reshape(-1, SPAN) for c in got.column("c").to_pylist()]
    net = train(chunks, got.column("y").to_numpy().astype(np.float32))
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def pool(batches):
        for b in batches:
            x = [sent.value.pooled(raw).astype(float) for raw in utf8(b.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("y")], names=["x", "y"])

    got = map_arrow(written.df.select("text", "y"), pool, "x array<double>, y int").toArrow()
    net.last, net.offset = refit(np.array(got.column("x").to_pylist(), float).reshape(-1, 2 * FILTERS), got.column("y").to_numpy().astype(float))
    written.drop()
    return net


def score(docs: DataFrame, net: Net, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score) of every row's whole text; a null or empty text is one chunk of zeros.
    Bytes are read as they are, UTF-8 or not.

    ``held_out`` is false for a null id. Repeated rows each get a row; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)
    picked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([sent.value.pooled(raw) for raw in utf8(batch.column("text"))], float).reshape(-1, 2 * FILTERS)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.probability(x))], names=["doc_id", "score"])

        return work

    scored = map_batches(picked, make, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score")
