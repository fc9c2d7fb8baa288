"""Sum-of-squares online packing of tokenised documents into fixed windows.

Each task packs the rows it reads, in their order, with a level array of its own: ``counts[h]``
is the number of open windows filled to ``h``. A document goes whole into the level where the
sum of squared counts of partially filled windows grows least (a fresh window is level 0); one
longer than a window first gives off full windows. What is open at the end is topped up: pieces
of the emptiest windows are cut into the gaps of the fullest, and the one window that remains is
cut at powers of two, which need no padding. Nothing is shuffled, and a task holds the ids of
its open windows only.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm.common import CACHE_KEY, map_arrow, text_of, utf8
from glosspark.llm.token_counts import model_path

MODEL = "word_bpe_49k.json"
WINDOW, END_ID = 4096, 2
#: Entries of a worker's cache from blank-separated chunk to ids (some 120 MB); long chunks stay out, and it starts afresh when full.
CACHE_SIZE = 600_000
SCHEMA = "doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


#: The tokenizer's own split, over Latin-1; such text is its own NFC and lower-cases letter by letter.
_LATIN = re.compile("[!-~\u00a1-\u00ff]+")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff]+|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]|[^0-9a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff\u00b2\u00b3\u00b9\u00bc-\u00be]+")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)}


class WordIds(dict):
    """Ids of one word as the split gives it, straight from the merge model."""

    def __init__(self, model, most: int = CACHE_SIZE):
        super().__init__()
        self.model, self.most, self.letters = model, most, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.letters)
        ids = np.array([t.id for t in self.model.tokenize(letters)], "<u4").tobytes()
        if len(word) <= CACHE_KEY:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


class ChunkIds(dict):
    """Ids (little-endian uint32 bytes) of a chunk of UTF-8 without ASCII white space.

    Where the vocabulary's rules never join text across white space, which is checked, a document's
    ids are those of its chunks one after another; else the whole text goes to the tokenizer. ``words`` serves printable Latin-1 chunks; others, and special
    strings, go to the tokenizer itself.
    """

    def __init__(self, tokenizer, most: int = CACHE_SIZE, by_word: bool = False):
        super().__init__()
        self.apart = separable(tokenizer)
        self.tokenizer, self.most, self.words = tokenizer, most, WordIds(tokenizer.model, most // 2) if by_word else None

    def __missing__(self, raw: bytes) -> bytes:
        chunk = text_of(raw)
        if self.words is not None and _LATIN.fullmatch(chunk) and "<|" not in chunk:
            ids = b"".join(map(self.words.__getitem__, _SPLIT.findall(chunk.lower())))
        else:
            ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
        if len(raw) <= CACHE_KEY:
            if len(self) >= self.most:
                self.clear()
            self[raw] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        if not self.apart:
            return np.array(self.tokenizer.encode(text_of(text), add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, text.split()))


def separable(tokenizer) -> bool:
    """Whether a text's ids are those of its chunks between ASCII white space: the first split drops
    what it does not match, it never matches white space, and no special string has or strips any."""
    made = json.loads(tokenizer.to_str())
    first = made["pre_tokenizer"] or {}
    first = first["pretokenizers"][0] if first.get("type") == "Sequence" else first
    kept = [n for n in [made["normalizer"]] if n]
    kept = [x for n in kept for x in (n["normalizers"] if n["type"] == "Sequence" else [n])]
    plain = all(n["type"] in ("NFC", "Lowercase") or n == {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "} for n in kept)
    if not plain or first.get("type") != "Split" or first.get("behavior") != "Removed" or not first.get("invert"):
        return False
    if any(t["lstrip"] or t["rstrip"] or t["content"].split() != [t["content"]] for t in made["added_tokens"]):
        return False
    probe = " ".join(a + blank + b for blank in " \t\n\r\x0b\x0c" for a in "a1.'é数" for b in "a1.'é数")
    return not any(probe[s:e].split() != [probe[s:e]] for _, (s, e) in tokenizer.pre_tokenizer.pre_tokenize_str(probe))


class Packer:
    """Windows of one task. A piece is (row, start, ids); ``closed`` has the finished sequences."""

    def __init__(self, window: int = WINDOW):
        self.window, self.counts = window, np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = defaultdict(list)
        self.closed: list[list] = []

    def level(self, size: int) -> int:
        """The fill level whose use adds least to the sum of squares; of equals the fullest."""
        room, c = self.window - size, self.counts
        gain = 2 * (c[size : self.window + 1] - c[: room + 1]) + 2  # from h to h + size
        gain[0] = 2 * c[size] + 1  # a fresh window leaves no level
        gain[room] = 1 - 2 * c[room] if room else 0  # a full window is counted no more
        gain[1:][c[1 : room + 1] == 0] = np.iinfo(np.int64).max
        return room - int(np.argmin(gain[::-1]))

    def add(self, row, ids: bytes) -> None:
        n, full = len(ids) // 4, self.window * 4
        whole = n // self.window
        for k in range(whole):
            self.closed.append([(row, k * self.window, ids[k * full : (k + 1) * full])])
        size = n - whole * self.window
        if not size:
            return
        h = self.level(size)
        pieces = self.open[h].pop() if h else []
        pieces.append((row, whole * self.window, ids[whole * full :]))
        if h:
            self.counts[h] -= 1
        if h + size == self.window:
            self.closed.append(pieces)
        else:
            self.counts[h + size] += 1
            self.open[h + size].append(pieces)

    def finish(self) -> None:
        """Top up the open windows; all are full then but one, which is cut at powers of two."""
        left = [(h, p) for h in sorted(self.open) for p in self.open[h]]
        self.open.clear()
        self.counts[:] = 0
        low, high = 0, len(left) - 1
        while low < high:
            (fill, pieces), (rest, giving) = left[high], left[low]
            while fill < self.window and giving:
                row, start, ids = giving.pop()
                n = min(len(ids) // 4, self.window - fill)
                pieces.append((row, start, ids[: 4 * n]))
                if 4 * n < len(ids):
                    giving.append((row, start + n, ids[4 * n :]))
                fill, rest = fill + n, rest - n
            left[high], left[low] = (fill, pieces), (rest, giving)
            if fill == self.window:
                self.closed.append(pieces)
                high -= 1
            if not giving:
                low += 1
        if low == high:
            fill, pieces = left[low]
            pieces = pieces[::-1]
            while fill:
                most = 1 << (fill.bit_length() - 1)
                fill -= most
                own: list = []
                while most:
                    row, start, ids = pieces.pop()
                    n = min(len(ids) // 4, most)
                    own.append((row, start, ids[: 4 * n]))
                    if 4 * n < len(ids):
                        pieces.append((row, start + n, ids[4 * n :]))
                    most -= n
                self.closed.append(own)


_loaded: dict[str, ChunkIds] = {}


def chunk_ids(model: str) -> ChunkIds:
    if model not in _loaded:
        from tokenizers import Tokenizer

        _loaded[model] = ChunkIds(Tokenizer.from_file(model_path(model)), by_word=model.endswith(MODEL))
    return _loaded[model]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, window: int = WINDOW, end_id: int | None = END_ID) -> DataFrame:
    """Pieces of all rows' ids: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset).

    A null or empty text has the end id alone (no row without one). Repeated rows and null ids are
    documents of their own. Bytes that are not UTF-8 are read as U+FFFD. Other columns are not read.
    An empty table gives no rows. ``sequence_id`` is the task's number times 2^33 plus a count within it.
    """
    picked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = picked.schema["doc_id"].dataType.simpleString()
    end = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer, made = chunk_ids(model), Packer(window), TaskContext.get().partitionId() << 33
        id_type = None

        def out() -> pa.RecordBatch:
            nonlocal made
            cols: list[list] = [[] for _ in range(7)]
            for pieces in packer.closed:
                offset = 0
                for (key, total), start, ids in pieces:
                    n = len(ids) // 4
                    for c, v in zip(cols, (key, start, n, zlib.crc32(ids), total, made, offset)):
                        c.append(v)
                    offset += n
                made += 1
            packer.closed.clear()
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=names)

        for batch in batches:
            keys = batch.column("doc_id")
            id_type = keys.type
            for key, raw in zip(keys.to_pylist(), utf8(batch.column("text"))):
                ids = (ids_of.ids(raw) if raw else b"") + end
                packer.add((key, len(ids) // 4), ids)
                if len(packer.closed) >= 2_000:
                    yield out()
        packer.finish()
        if packer.closed:
            yield out()

    return map_arrow(picked, run, SCHEMA.format(id=kind))
