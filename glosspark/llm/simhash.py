"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints: lower-cased A-Z, words between ASCII white space, word shingles joined by a
space with repeats, XXH64 (seed 42) of each, one bit per position where over half of the
hashes have it. Two fingerprints link at ``max_distance`` or fewer differing bits and a
component is a set of fingerprints that links connect.

The join is exact at every size. The 64 bits are cut into ``m`` blocks; two fingerprints
within the distance agree on at least ``m - max_distance`` whole blocks, so each choice of
that many blocks is a mask, and (mask, masked pattern) is an upper node that both share.
Below an upper node the fingerprints are sorted by Gray rank and eights of neighbours are
factored into nodes again, each with the bits that all its members share. Pairs of nodes
whose shared bits already differ in too many places are pruned whole; so are pairs whose
members are known to be connected. An upper node never yields pairs, only a star per
component found in it, so what is shuffled grows with the rows. Upper nodes above
``node_rows`` are dealt out in tiles, each pair of tiles a task of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm.common import Written, map_arrow, map_batches, utf8

SEED = 42
#: A fingerprint of more than one in so many rows is hot; there are fewer hot ones than that.
HOT_SHARE = 200
FAN = 8  # members of a node
SLICE = 100_000  # hashes whose bits are unpacked at once, 64 bytes each


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per run of hashes the count of each of the 64 bits, least significant first."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int64)


def fingerprints_of(texts: list[bytes | None], words: int = 4) -> np.ndarray:
    """SimHash of each UTF-8 text as uint64; no words (null or blank text): 0."""
    digest, runs, counts = xxhash.xxh64_intdigest, [], np.zeros(len(texts), np.int64)
    out = np.zeros(len(texts), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    held, first = 0, 0

    def close(last: int) -> None:
        nonlocal runs, held, first
        if runs:
            n = counts[first:last]
            some = np.flatnonzero(n)
            starts = np.concatenate(([0], np.cumsum(n[some])[:-1]))
            sums = _bit_counts(np.concatenate(runs), starts)
            out[first + some] = ((sums * 2 > n[some, None]) * weights).sum(axis=1, dtype=np.uint64)
        runs, held, first = [], 0, last

    for i, text in enumerate(texts):
        parts = text.lower().split() if text else []
        if parts:
            joined = b" ".join(parts)
            n = max(1, len(parts) - words + 1)
            ends = np.cumsum([len(p) + 1 for p in parts]) - 1
            begins = np.concatenate(([0], ends[:-1] + 1))[:n]
            ends = ends[words - 1 :] if len(parts) >= words else ends[-1:]
            hashed = lambda a: np.fromiter((digest(joined[s:e], SEED) for s, e in zip(begins[a : a + SLICE].tolist(), ends[a : a + SLICE].tolist())), np.uint64)  # noqa: B023, E731
            if n > SLICE:  # a text of its own, slice by slice
                sums = sum(_bit_counts(hashed(a), np.zeros(1, int))[0] for a in range(0, n, SLICE))
                out[i] = ((sums * 2 > n) * weights).sum(dtype=np.uint64)
            else:
                counts[i] = n
                runs.append(hashed(0))
                held += n
        if held > SLICE:
            close(i + 1)
    close(len(texts))
    return out


def fingerprint(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), words: int = 4) -> DataFrame:
    """``keep`` columns and ``fp`` (the 64 bits as a long) for every row, one output row per input row."""
    picked = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.select(*[f"`{c}`" for c in keep]).schema)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = fingerprints_of(utf8(batch.column("__text")), words).view(np.int64)
            return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(fps)], names=[*keep, "fp"])

        return work

    return map_batches(picked, make, f"{schema}, fp bigint")


# --- the join ---------------------------------------------------------------------------------


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each code word in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _roots(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels (the smallest index reachable) after adding edges a-b to the components in ``label``."""
    while True:
        la, lb = label[a], label[b]
        low, high = np.minimum(la, lb), np.maximum(la, lb)
        keep = low < high
        if not keep.any():
            return label
        a, b, low, high = a[keep], b[keep], low[keep], high[keep]
        np.minimum.at(label, high, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


class GrayIndex:
    """Hierarchical index over one set of fingerprints, each under one upper node (``group``).

    ``self_join`` gives the component of each one within its group. Frontiers are cut in
    pieces of ``chunk`` node pairs, so memory is bounded by the set and not by its pairs.
    """

    def __init__(self, fps: np.ndarray, group: np.ndarray, distance: int, chunk: int = 1 << 18):
        order = np.lexsort((gray_rank(fps), group))
        self.fps, self.group, self.order, self.distance, self.chunk = fps[order], group[order], order, distance, chunk
        n = len(fps)
        self.levels = [(self.fps, self.fps, self.group, np.arange(n + 1))]  # and, or, group, first child
        while True:
            low, high, own, _ = self.levels[-1]
            if len(own) == len(np.unique(own)):
                break
            new = np.concatenate(([True], own[1:] != own[:-1]))
            at = np.arange(len(own)) - np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))
            first = np.flatnonzero(at % FAN == 0)
            self.levels.append((np.bitwise_and.reduceat(low, first), np.bitwise_or.reduceat(high, first), own[first], np.append(first, len(own))))

    def self_join(self) -> np.ndarray:
        n = len(self.fps)
        self.label = np.arange(n)
        if n > 1:
            near = np.flatnonzero((self.group[1:] == self.group[:-1]) & (np.bitwise_count(self.fps[1:] ^ self.fps[:-1]) <= self.distance))
            self.label = _roots(n, near, near + 1, self.label)
            top = len(self.levels) - 1
            all_top = np.arange(len(self.levels[top][2]))
            self._descend(top, all_top, all_top)
        out = np.empty(n, np.int64)
        out[self.order] = self.order[self.label]
        return out

    def _span(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first, last = node, node + 1
        for k in range(level, 0, -1):
            bounds = self.levels[k][3]
            first, last = bounds[first], bounds[last]
        return first, last

    def _descend(self, level: int, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs of nodes a <= b of one level whose shared bits are near enough."""
        for s in range(0, len(a), self.chunk):
            x, y = a[s : s + self.chunk], b[s : s + self.chunk]
            low, high, _, bounds = self.levels[level]
            apart = np.bitwise_count((low[x] & ~high[y]) | (low[y] & ~high[x]))  # differences that all members have
            keep = apart <= self.distance
            x, y = x[keep], y[keep]
            if level == 0:
                self.label = _roots(len(self.fps), x, y, self.label)
                continue
            if len(x) > 64:  # pairs that are connected through and through add nothing
                (fx, lx), (fy, ly) = self._span(level, x), self._span(level, y)
                edge = np.concatenate(([0], np.cumsum(self.label[1:] != self.label[:-1])))
                one = (edge[lx - 1] == edge[fx]) & (edge[ly - 1] == edge[fy]) & (self.label[fx] == self.label[fy])
                x, y = x[~one], y[~one]
            if not len(x):
                continue
            step = max(1, self.chunk // (FAN * FAN))
            for t in range(0, len(x), step):
                u, v = x[t : t + step], y[t : t + step]
                i = bounds[u][:, None, None] + np.arange(FAN)[None, :, None]
                j = bounds[v][:, None, None] + np.arange(FAN)[None, None, :]
                ok = (i < bounds[u + 1][:, None, None]) & (j < bounds[v + 1][:, None, None]) & (i < j if level == 1 else i <= j)
                i, j = np.broadcast_arrays(i, j)
                if ok.any():
                    self._descend(level - 1, i[ok], j[ok])


def masks(n: int, distance: int, per_node: int = 4096) -> list[int]:
    """Masks of the upper nodes: with these every pair within the distance shares a node.

    The number of blocks follows from the number of fingerprints alone, so that evenly spread
    ones leave ``per_node`` at most in a node: comparing that many costs a tenth of a text's
    fingerprint, while each further block multiplies what is shuffled. It moves work, never results.
    """
    m = distance + 1
    while m < distance + 4 and n / 2 ** (64 * (m - distance) // m) > per_node:
        m += 1
    cuts = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(c) for c in combinations(blocks, m - distance)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def links(fps: DataFrame, n: int, distance: int = 4, node_rows: int = 200_000) -> DataFrame:
    """Star edges (a, b), a < b as longs, that connect the distinct ``fp`` values exactly as all links do.

    Upper nodes with more than ``node_rows`` fingerprints are cut into tiles by hash; each pair of
    tiles is joined by itself, so no task holds more than two tiles of one node.
    """
    choice = masks(n, distance)
    nodes = F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(_signed(x))).alias("p")) for k, x in enumerate(choice)])
    keyed = fps.select("fp", F.explode(nodes).alias("node")).select("fp", "node.k", "node.p")
    tiled = keyed.withColumns({"a": F.lit(0), "b": F.lit(0)})
    if n > node_rows:  # fewer fingerprints than that cannot overfill a node
        full = keyed.groupBy("k", "p").count().where(F.col("count") > node_rows)
        if not full.isEmpty():
            full = full.select("k", "p", F.ceil(F.col("count") / node_rows * 2).cast("int").alias("tiles"))
            own = F.pmod(F.xxhash64("fp", "k"), F.col("tiles")).cast("int")
            split = keyed.join(full, ["k", "p"]).withColumn("own", own)
            split = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
            split = split.select("fp", "k", "p", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))
            tiled = tiled.join(full, ["k", "p"], "left_anti").select("fp", "k", "p", "a", "b").unionByName(split)
    parts = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n * len(choice) // 1_000_000)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if held is None or not held.num_rows:
            return
        cols = [held.column(c).to_numpy() for c in ("k", "p", "a", "b")]
        order = np.lexsort(cols[::-1])
        new = np.zeros(len(order), bool)
        for c in cols:
            new[1:] |= c[order][1:] != c[order][:-1]
        values = held.column("fp").to_numpy()[order]
        group = np.cumsum(new)
        starts = np.append(np.flatnonzero(np.concatenate(([True], new[1:]))), len(order))
        batch: list[int] = [0]  # several small nodes at once, one large one by itself
        for g in range(1, len(starts)):
            if starts[g] - starts[batch[0]] >= 100_000 or g == len(starts) - 1:
                s, e = starts[batch[0]], starts[g]
                found = GrayIndex(values[s:e].view(np.uint64), group[s:e], distance).self_join()
                own, root = values[s:e], values[s:e][found]
                far = own != root
                if far.any():
                    own, root = own[far], root[far]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(own, root)), pa.array(np.maximum(own, root))], names=["a", "b"])
                batch = [g]

    return map_arrow(tiled.repartition(parts, "k", "p", "a", "b"), join, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root the smallest long of its component.

    Alternating large and small stars; each round is written to the shared folder, so no lineage
    grows and nothing is gathered on the driver but two numbers a round.
    """
    now, before = Written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges"), None
    while True:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        after = Written(small.select("e.u", "e.v").where("u > v").distinct(), "edges")
        mark = after.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now.drop()
        now = after
        if mark == before:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = mark


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", words: int = 4, distance: int = 4, node_rows: int = 200_000) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``.

    A null text has no words: fingerprint 0, linked like any other. A null id never names a
    component unless all its rows have null ids (then it is null). Repeated rows each get a row.
    Columns other than the two named are not read. An empty table gives no rows.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    marked = Written(fingerprint(own, words=words), "fingerprints").df
    fps = Written(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct").df
    size, total = fps.agg(F.count("*"), F.sum("n")).first()
    found = components(links(fps.select("fp"), size, distance, node_rows))
    named = found.join(fps, found.node == fps.fp).select("node", "root", "first")
    least = named.groupBy("root").agg(F.min("first").alias("least"))
    linked = named.join(least, "root").select(F.col("node").alias("fp"), "least")
    classes = fps.join(linked, "fp", "left").select("fp", "n", F.coalesce("least", "first").alias("component_id"))
    # the rows of a frequent fingerprint stay where they are: its class goes to them
    hot = F.broadcast(classes.where(F.col("n") > (total or 0) / HOT_SHARE).drop("n"))
    rest = marked.join(hot, "fp", "left_anti").join(classes.drop("n"), "fp")
    return marked.join(hot, "fp").unionByName(rest).select("doc_id", "fp", "component_id")


def fingerprint_hex(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
