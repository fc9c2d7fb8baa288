"""Benchmark decontamination by a prefix-filtered join of item windows with documents.

A window is ``window`` consecutive words of an item (a shorter item is one window). Its set of
word shingles must lie wholly in a document that holds it, so of the shingles in order of rarity
a prefix of one is necessary: the rarest. Pass one counts the benchmark's shingles over all
documents; pass two joins each document's shingles with the windows' rarest ones, drops
alignments that would leave the document (length and position bounds) and compares the words
themselves. Both passes are narrow: what is shuffled is one count per shingle and task.

Items within ``block_bytes`` of text are broadcast whole. More of them stay distributed: a bit map of
fixed size sieves the documents' shingles, and windows and documents are joined by the rarest shingle.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm.common import CACHE_KEY, Rows, Written, map_arrow, map_batches, utf8

WINDOW, SHINGLE = 10, 5
#: Text of items that is broadcast; a worker and the driver hold some hundred times that in windows and counts.
BLOCK_BYTES = 2 << 20
#: Bits of the sieve over shingles of larger benchmarks (32 MB), and parts that a shared key is dealt out to.
SIEVE_BITS, SALTS = 28, 16
SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
RESULT = "doc_id {id}, n_words bigint, hits array<struct<start:bigint,stop:bigint>>, items array<string>"
#: A-Z become a-z; other ASCII but digits and a-z become blanks; bytes from 0x80 stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def _hashes(words: list[bytes], size: int) -> np.ndarray:
    """A hash of every run of ``size`` words, good within one process; matches are compared in full."""
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * _ODD + h[k : k + n]
    return out ^ (out >> np.uint64(29))


class Windows:
    """The windows of some items, found by one shingle each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, shingle: int = SHINGLE, counts: dict | None = None):
        self.windows: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, text in items:
            w = words_of(text)
            for i in range(max(1, len(w) - window + 1) if w else 0):
                self.windows[tuple(w[i : i + window])].add(item)
        self.shingle, self.counts = shingle, counts
        found: dict[int, dict[int, list]] = defaultdict(lambda: defaultdict(list))
        for words in self.windows:
            size = min(shingle, len(words))
            at = range(len(words) - size + 1)
            if counts is not None:  # the necessary prefix: the rarest shingle, the first of equals
                at = [min(at, key=lambda i: counts.get(words[i : i + size], 0))]
            own = _hashes(list(words), size)
            for i in at:
                found[size][int(own[i])].append((i, words))
        self.index = {}
        for size, by_hash in found.items():
            keys = np.array(sorted(by_hash), np.uint64)
            bits = max(10, 4 + int(len(keys)).bit_length())
            sieve = np.zeros(1 << bits, bool)
            sieve[(keys & np.uint64((1 << bits) - 1)).astype(np.int64)] = True
            self.index[size] = (keys, sieve, np.uint64((1 << bits) - 1), by_hash)

    def shingles(self, words: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where in ``words`` an indexed shingle may stand, and its hash."""
        keys, sieve, mask, _ = self.index[size]
        own = _hashes(words, size)
        at = np.flatnonzero(sieve[(own & mask).astype(np.int64)])
        got = own[at]
        place = np.searchsorted(keys, got)
        ok = keys[np.minimum(place, len(keys) - 1)] == got if len(keys) else np.zeros(0, bool)
        return at[ok], got[ok]

    def count(self, words: list[bytes], into: dict) -> None:
        for size in self.index:
            at, _ = self.shingles(words, size)
            for p in at.tolist():
                into[tuple(words[p : p + size])] += 1

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges that occurrences cover, and the items they are of."""
        hits, items, n = set(), set(), len(words)
        for size, (_, _, _, by_hash) in self.index.items():
            at, got = self.shingles(words, size)
            for p, h in zip(at.tolist(), got.tolist()):
                for i, window in by_hash[h]:
                    s = p - i
                    if 0 <= s <= n - len(window) and (s, s + len(window)) not in hits and tuple(words[s : s + len(window)]) == window:
                        hits.add((s, s + len(window)))
                        items |= self.windows[window]
        return sorted(hits), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(ranges):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _own_items(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id string, text) of the items that may take part."""
    return items.select(F.col(f"`{item_id}`").cast("string").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text")).where("item_id is not null and text is not null")


def _few(items: DataFrame, block_bytes: int) -> list[tuple[str, bytes]] | None:
    """The items, if they are at most ``block_bytes`` of text."""
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    return [(r[0], bytes(r[1])) for r in items.select("item_id", F.col("text").cast("binary")).collect()] if size <= block_bytes else None


def shingle_counts(docs: DataFrame, items: list[tuple[str, bytes]], window: int, shingle: int) -> dict:
    """How often each shingle of the items' windows occurs in all documents."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(items)

    def run(batches):
        windows, into = Windows(sent.value, window, shingle), defaultdict(int)
        for batch in batches:
            for raw in utf8(batch.column(0)):
                windows.count(words_of(raw), into)
        yield pa.RecordBatch.from_arrays([pa.array([b" ".join(k) for k in into], pa.binary()), pa.array(list(into.values()), pa.int64())], names=["s", "n"])

    rows = map_arrow(docs.select("text"), run, "s binary, n bigint").groupBy("s").agg(F.sum("n").alias("n")).collect()
    return {tuple(bytes(r[0]).split(b" ")): r[1] for r in rows}


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, hits array<struct<start,stop>> as word ranges, items array of item ids as strings) for every row.

    Null and blank texts have no words and no hits. Items with a null id or without words take no
    part; items with equal texts are each named; repeated item rows count once. Repeated rows of
    documents each get a row. Bytes that are not UTF-8 are parts of words, as they stand. Items of more
    than ``block_bytes`` are not broadcast but joined; two passes over the documents do in any case.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    wanted = _own_items(items, item_id, item_text)
    few = _few(wanted, block_bytes)
    if few is not None:
        return _one_block(own, few, window, shingle)
    rows, matches, names = _joined(own.withColumn("row", F.monotonically_increasing_id()), ("row", "doc_id"), wanted, window, shingle)
    hits = matches.groupBy("row").agg(F.collect_set(F.struct("start", "stop")).alias("hits")).join(names.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "row")
    base = rows.where("s is null").select("row", "doc_id", "n_words").join(hits, "row", "left")
    kind = own.schema["doc_id"].dataType.simpleString()

    def merge(batches):
        for b in batches:
            spans = [[{"start": x, "stop": y} for x, y in merged([(r["start"], r["stop"]) for r in h or ()])] for h in b.column("hits").to_pylist()]
            named = [h or [] for h in b.column("items").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_words"), pa.array(spans, pa.list_(SPAN)), pa.array(named, pa.list_(pa.string()))], names=["doc_id", "n_words", "hits", "items"])

    return map_arrow(base.select("doc_id", "n_words", "hits", "items"), merge, RESULT.format(id=kind))


# --- items that are too many to broadcast -----------------------------------------------------


def _stable(words: list[bytes], size: int, known: dict[bytes, int]) -> np.ndarray:
    """Hashes of every run of ``size`` words that are the same in every process."""
    digest = xxhash.xxh64_intdigest
    h = np.empty(len(words), np.uint64)
    for k, w in enumerate(words):
        v = known.get(w)
        if v is None:
            v = digest(w)
            if len(w) <= CACHE_KEY:
                if len(known) >= 250_000:
                    known.clear()
                known[w] = v
        h[k] = v
    n = len(words) - size + 1
    out = np.full(max(n, 0), size, np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * _ODD + h[k : k + n]
    return (out ^ (out >> np.uint64(29))).view(np.int64)


class Sieve:
    """A bit map of hashes, by their low bits: of fixed size, so that it can be broadcast whatever it holds.
    What it lets through in error costs a row in a shuffle, never a result."""

    def __init__(self, hashes: DataFrame, bits: int = SIEVE_BITS):
        at = F.col("s").bitwiseAND(F.lit((1 << bits) - 1)) + 1
        maps = hashes.select(F.bitmap_bucket_number(at).alias("k"), F.bitmap_bit_position(at).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("b")).toArrow()
        self.flat = np.zeros(max(1 << bits, 1 << 15) // 8, np.uint8)
        for k, b in zip(maps.column("k").to_pylist(), maps.column("b").to_pylist()):
            self.flat[(k - 1) * 4096 : k * 4096] = np.frombuffer(b, np.uint8)
        self.mask = np.int64((1 << bits) - 1)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Where in ``hashes`` one stands that may be known."""
        low = hashes & self.mask
        return np.flatnonzero((self.flat[low >> 3] >> (low & 7).astype(np.uint8)) & 1)


def _windows_of(items: DataFrame, window: int) -> DataFrame:
    """(item_id, words binary, n) of every item's different windows."""

    def run(batches):
        for b in batches:
            for item, raw in zip(b.column("item_id").to_pylist(), utf8(b.column("text"))):
                w = words_of(raw)
                n = min(window, len(w))
                for at in range(0, max(1, len(w) - window + 1) if w else 0, 10_000):
                    own = [b" ".join(w[i : i + n]) for i in range(at, min(at + 10_000, len(w) - n + 1))]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.string()), pa.array(own, pa.binary()), pa.array([n] * len(own), pa.int32())], names=["item_id", "words", "n"])

    return map_arrow(items.select("item_id", "text"), run, "item_id string, words binary, n int").distinct()


def _joined(docs: DataFrame, keep: tuple[str, ...], items: DataFrame, window: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The prefix-filtered join as a shuffle: (rows, matches, names).

    ``rows``, written down: for each of ``docs`` its ``keep`` and ``n_words`` with a null ``s``, and for each place ``p``
    where a window's rarest shingle ``s`` may stand the words around it, the first of which is number ``at``.
    ``matches`` (keep, start, stop, words): windows that stand there. ``names`` (keep, item_id): the items they are of.
    A document's text is never shuffled; keys that many documents share are salted, as the windows are few beside them.
    """
    windows = Written(_windows_of(items, window), "windows")
    sent = docs.sparkSession.sparkContext.broadcast

    def shingles(batches):
        known: dict[bytes, int] = {}
        for b in batches:
            for words in b.column("words").to_pylist():
                parts = words.split(b" ")
                own = _stable(parts, min(shingle, len(parts)), known)
                yield pa.RecordBatch.from_arrays([pa.array([words] * len(own), pa.binary()), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own), pa.array([min(shingle, len(parts))] * len(own), pa.int32())], names=["words", "i", "s", "size"])

    every = Written(map_arrow(windows.df.select("words").distinct(), shingles, "words binary, i int, s bigint, size int"), "shingles")
    sizes = sorted(r[0] for r in every.df.select("size").distinct().collect())  # 1 to ``shingle``
    sieve = sent(Sieve(every.df))

    def count(batches):
        known, into = {}, defaultdict(int)

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(list(into), pa.int64()), pa.array(list(into.values()), pa.int64())], names=["s", "c"])
            into.clear()

        for b in batches:
            for raw in utf8(b.column("text")):
                words = words_of(raw)
                for size in sizes:
                    own = _stable(words, size, known)
                    for s in own[sieve.value(own)].tolist():
                        into[s] += 1
            if len(into) > 200_000:
                yield from flush()
        yield from flush()

    counts = map_arrow(docs.select("text"), count, "s bigint, c bigint").groupBy("s").agg(F.sum("c").alias("c"))
    rare = every.df.join(counts, "s", "left").groupBy("words").agg(F.min_by(F.struct("s", "i"), F.struct(F.coalesce("c", F.lit(0)), "i")).alias("r"))  # the necessary prefix
    prefix = Written(rare.select("words", "r.s", "r.i"), "prefixes")
    chosen = sent(Sieve(prefix.df))
    names = [*keep, "n_words", "s", "p", "at", "around"]

    def find(batches):
        known: dict[bytes, int] = {}
        for b in batches:
            texts = utf8(b.column("text"))
            keys = [b.column(c) for c in keep]
            words = [words_of(raw) for raw in texts]
            n = len(texts)
            none = [pa.nulls(n, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(list(map(len, words)), pa.int64()), *none], names=names)
            for row, w in enumerate(words):
                for size in sizes:
                    own = _stable(w, size, known)
                    places = chosen.value(own)
                    for a in range(0, len(places), 10_000):
                        some = places[a : a + 10_000]
                        first = np.maximum(0, some - window + 1)
                        around = [b" ".join(w[x : p + window]) for x, p in zip(first.tolist(), some.tolist())]
                        key = [pa.array([c[row].as_py()] * len(some), c.type) for c in keys]
                        yield pa.RecordBatch.from_arrays([*key, pa.array([len(w)] * len(some), pa.int64()), pa.array(own[some]), pa.array(some), pa.array(first), pa.array(around, pa.binary())], names=names)

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    rows = Written(map_arrow(docs.select(*keep, "text"), find, f"{kinds}, n_words bigint, s bigint, p bigint, at bigint, around binary"), "candidates").df
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    salted = rows.where("s is not null").withColumn("salt", F.pmod(F.xxhash64(*keep, "p"), F.lit(SALTS)).cast("int"))
    pairs = salted.join(prefix.df.withColumn("salt", salts), ["s", "salt"]).select(*keep, "n_words", "p", "at", "around", "words", "i")

    def verify(batches):
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("n_words", "p", "at", "around", "words", "i")]
            start, n, ok = [], [], []
            for total, place, at, around, words, i in zip(*cols):
                size, first = words.count(b" ") + 1, place - i
                start.append(first)
                n.append(first + size)
                ok.append(first >= 0 and first + size <= total and b" ".join(around.split(b" ")[first - at : first - at + size]) == words)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(start, pa.int64()), pa.array(n, pa.int64()), b.column("words")], names=[*keep, "start", "stop", "words"]).filter(pa.array(ok, pa.bool_()))

    matches = Written(map_arrow(pairs, verify, f"{kinds}, start bigint, stop bigint, words binary"), "matches").df
    held = matches.select(*keep, "words").distinct().withColumn("salt", F.pmod(F.xxhash64(*keep), F.lit(SALTS)).cast("int"))
    return rows, matches, held.join(windows.df.select("item_id", "words").withColumn("salt", salts), ["words", "salt"]).select(*keep, "item_id").distinct()


def _one_block(docs: DataFrame, items: list[tuple[str, bytes]], window: int, shingle: int) -> DataFrame:
    counts = shingle_counts(docs, items, window, shingle) if items else {}
    sent = docs.sparkSession.sparkContext.broadcast((items, counts))

    def make():
        windows = Windows(sent.value[0], window, shingle, sent.value[1])

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, hits, ids = [], [], []
            for raw in utf8(batch.column("text")):
                w = words_of(raw)
                ranges, found = windows.match(w)
                n.append(len(w))
                hits.append([{"start": s, "stop": e} for s, e in merged(ranges)])
                ids.append(sorted(found))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hits, pa.list_(SPAN)), pa.array(ids, pa.list_(pa.string()))], names=["doc_id", "n_words", "hits", "items"])

        return work

    return map_batches(docs.select("doc_id", "text"), make, RESULT.format(id=docs.schema["doc_id"].dataType.simpleString()))


def reject_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; a null text holds none. Narrow for items within
    ``block_bytes``; for more, rows are told apart by their place in the files they are read from."""
    names = docs.columns
    wanted = _own_items(items, item_id, item_text)
    few = _few(wanted, block_bytes)
    if few is None:
        rows = Rows(docs, "rows")
        _, matches, _ = _joined(rows.marked().select(rows.file, rows.at, F.col(f"`{text}`").cast("string").alias("text")), (rows.file, rows.at), wanted, window, shingle)
        return rows.without(matches.select(rows.file, rows.at).distinct())
    sent = docs.sparkSession.sparkContext.broadcast((few, shingle_counts(docs.select(F.col(f"`{text}`").cast("string").alias("text")), few, window, shingle) if few else {}))

    def run(batches):
        windows = Windows(sent.value[0], window, shingle, sent.value[1])
        for b in batches:
            yield b.filter(pa.array([not windows.match(words_of(raw))[0] for raw in utf8(b.column(names.index(text)))], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def digest(found: DataFrame) -> DataFrame:
    """The counts and item digest of ``decontaminate``'s rows; hit words are counted once."""
    flagged = F.aggregate(
        F.sort_array("hits"),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("to")),
        lambda a, r: F.struct((a.n + F.greatest(F.lit(0).cast("bigint"), r.stop - F.greatest(r.start, a.to))).alias("n"), F.greatest(a.to, r.stop).alias("to")),
    ).n
    names = F.sort_array("items")
    return found.select(
        "doc_id", "n_words", flagged.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()
