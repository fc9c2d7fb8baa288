"""Toxicity: boosted trees over dense features, with isotonic calibration.

A short general list of insults is joined by a lexicon learned from the training labels: words
and word beginnings that toxic documents hold far more often than others. Tokens are also read
with disguises undone (look-alikes, digits for letters, masked or stretched letters, letters
spaced out). Most features are rates over the whole text; its length and its number of matches
come in as logarithms. Lexicon features of training rows come from the other fold's lexicon, and the
calibration is fitted on log odds of trees that did not see the row.
"""

from __future__ import annotations

import math
import re
import string
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.llm.common import CACHE_KEY, Written, decoded, map_arrow, map_batches, remainder, text_of, utf8
from glosspark.llm.learning import Isotonic, Trees, training_rows
from glosspark.llm.pii import LOOK_ALIKES

#: At most so many labelled rows are learned from; they bound the lexicon too, which keeps every term that marks toxic ones.
TRAIN_ROWS = 12_000
#: A term marks toxic documents from so many of them on, as a number and a share, and from these log odds.
TERM_DOCS, TERM_SHARE, TERM_ODDS = 3, 0.003, 4.0
#: Tokens that a worker remembers.
CACHE_SIZE = 250_000
STEMS = (4, 5, 6, 7)
SEEDS = frozenset(
    "idiot idiots moron morons stupid dumb loser losers pathetic scum trash garbage worthless disgusting clown fool ugly jerk bastard imbecile "
    "idiota estúpido estúpida imbécil basura asqueroso dummkopf arschloch trottel abschaum connard imbécile crétin salaud ordure".split()
)
SECOND = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti tus usted ustedes vosotros".split())
_EDGE = re.compile(r"^[\W\d_]+|[\W\d_]+$")
_OUTER = re.compile(r"^(?:[^\w$@]|_)+|[\s.,;:!?\"')\]}_-]+$")
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "l", "€": "e"})
_ALIKE = str.maketrans(LOOK_ALIKES)
_MASK = re.compile(r"[*#@$%_.-]")
_STRETCH = re.compile(r"(.)\1{2,}")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .*_-]){3,}[^\W\d_](?![^\W_])")
_FOREIGN = re.compile("[\u0250-\uffff]")
_MIXED = re.compile(r"[^\W\d_][\d@$!*#|]+[^\W\d_]")
HIT, HIDDEN, YOU, CAPS, MIXED, STRETCHED, SEED, STRONG, SINGLE, DOTTED = (1 << k for k in range(10))
_EDGES = string.punctuation.replace("$", "").replace("@", "") + "…“”«»„‘’¡¿–—"
FEATURES = (
    "words hits hidden strong seeds you near caps mixed stretched spaced any_hits any_strong upper exclaim question punctuation digits accents".split()
)


def terms_of(token: str) -> tuple[str, ...]:
    """A word and its beginnings of 4 to 7 letters, marked by a dash."""
    w = token.strip(_EDGES).lower()
    if not w.isalpha():
        w = _EDGE.sub("", w)
    return (w, *(w[:k] + "-" for k in STEMS if len(w) > k)) if len(w) > 2 else ()


@dataclass
class Lexicon:
    weights: dict[str, float]
    strong: frozenset[str]

    def __post_init__(self):
        self.by_length: dict[int, list[str]] = {}
        self.words = SEEDS.union(w for w in self.weights if not w.endswith("-"))
        stems = {k: frozenset(w[:-1] for w in self.weights if w.endswith("-") and len(w) == k + 1) for k in STEMS}
        self.stems = [(k, known) for k, known in stems.items() if known]
        for w in self.words:
            self.by_length.setdefault(len(w), []).append(w)

    def word(self, w: str) -> str | None:
        """The term that a lower-case word matches."""
        if w in self.words:
            return w
        for k, known in self.stems:
            if w[:k] in known and len(w) > k:
                return w[:k] + "-"
        return None

    def find(self, token: str) -> str | None:
        w = token.strip(_EDGES).lower()
        return self.word(w if w.isalpha() else _EDGE.sub("", w))

    def hidden(self, token: str) -> str | None:
        """The term that a disguised token stands for."""
        core = _OUTER.sub("", token).lower().translate(_ALIKE)
        if len(core) < 3:
            return None
        tries = {core, _STRETCH.sub(r"\1", core), _STRETCH.sub(r"\1\1", core)}
        tries |= {t.translate(_LEET) for t in tries} | {t.replace("1", "l").translate(_LEET) for t in tries}
        tries |= {re.sub(r"[\W\d_]", "", t) for t in tries}
        for t in tries:
            if t != token.lower() and (found := self.find(t)):
                return found
        if _MASK.search(core) and sum(map(str.isalpha, core)) >= 2 and sum(map(str.isalpha, core)) * 2 >= len(core):
            like = re.compile("".join("." if _MASK.match(c) else re.escape(c) for c in core))
            return next((w for w in self.by_length.get(len(core), ()) if like.fullmatch(w)), None)
        return None


class Flags(dict):
    """Token -> its eight flags, remembered until full."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, token: str) -> int:
        core = token.strip(_EDGES)
        low = core.lower()
        flag = YOU if low in SECOND else 0
        if len(core) < 2:
            flag |= SINGLE if core.isalpha() else 0
        else:
            flag |= CAPS if core.isupper() else 0
            found, hidden = self.lexicon.word(low), 0
            whole = low.isalpha()
            stretched = _STRETCH.search(low)
            if not whole:
                flag |= (MIXED if _MIXED.search(core) else 0) | (DOTTED if _SPACED.search(core) else 0)
            if stretched:
                flag |= STRETCHED
            if not found and (not whole or stretched or (not low.isascii() and _FOREIGN.search(low))):
                found = self.lexicon.find(token)
                if not found and (found := self.lexicon.hidden(token)):
                    hidden = HIDDEN
            if found:
                flag |= HIT | hidden | (SEED if found in SEEDS else 0) | (STRONG if found in self.lexicon.strong else 0)
        if len(token) <= CACHE_KEY:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[token] = flag
        return flag

    def features(self, raw: bytes | None) -> list[float]:
        text = text_of(raw) if raw else ""
        words = text.split()
        n = max(len(words), 1)
        flags = np.frombuffer(array("H", map(self.__getitem__, words)), np.uint16) if words else np.zeros(0, np.uint16)
        count = lambda bit: float(np.count_nonzero(flags & bit)) if len(flags) else 0.0
        hits, strong = count(HIT), count(STRONG)
        near = 0
        if hits and (you := np.flatnonzero(flags & YOU)).size:
            at = np.flatnonzero(flags & HIT)
            k = np.searchsorted(you, at)
            gap = np.minimum(np.abs(you[np.minimum(k, you.size - 1)] - at), np.abs(you[np.maximum(k - 1, 0)] - at))
            near = int((gap <= 5).sum())
        alone = (flags & SINGLE) > 0
        spelled = (alone[:-3] & alone[1:-2] & alone[2:-1] & alone[3:]).any() or (flags & DOTTED).any()  # worth a look at the text
        spaced = sum(1 for m in _SPACED.finditer(text) if self.lexicon.find(re.sub(r"[\W_]", "", m[0]))) if spelled else 0
        c = max(len(raw), 1) if raw else 1
        b = np.frombuffer(raw or b"", np.uint8)
        sizes = np.bincount(b, minlength=256) if len(b) else np.zeros(256, int)
        punct = sizes[33:48].sum() + sizes[58:65].sum() + sizes[91:97].sum() + sizes[123:127].sum()
        return [
            math.log1p(n), 100 * hits / n, 100 * count(HIDDEN) / n, 100 * strong / n, 100 * count(SEED) / n, 100 * count(YOU) / n, 100 * near / n, count(CAPS) / n, count(MIXED) / n, count(STRETCHED) / n,
            float(spaced), math.log1p(hits + spaced), math.log1p(strong + spaced), sizes[65:91].sum() / c, sizes[33] / c, sizes[63] / c, punct / c, sizes[48:58].sum() / c, sizes[128:].sum() / c,
        ]


def learn_lexicon(rows: list[tuple[str, int, int, int]], totals: dict[int, tuple[int, int]], folds: tuple[int, ...]) -> Lexicon:
    """From (term, fold, toxic documents, other documents) rows of ``folds``."""
    n1, n0 = (sum(totals.get(f, (0, 0))[k] for f in folds) for k in (0, 1))
    seen: dict[str, list[int]] = {}
    for term, fold, a, b in rows:
        if fold in folds:
            s = seen.setdefault(term, [0, 0])
            s[0] += a
            s[1] += b
    weights, strong = {}, set()
    for term, (a, b) in seen.items():
        if a < max(TERM_DOCS, TERM_SHARE * n1):
            continue
        odds = math.log((a + 0.5) / (n1 - a + 0.5)) - math.log((b + 0.5) / (n0 - b + 0.5))
        if odds > TERM_ODDS:
            weights[term] = odds
            if a >= max(TERM_DOCS, 5 * TERM_SHARE * n1):
                strong.add(term)
    return Lexicon(weights, frozenset(strong))


@dataclass
class Model:
    lexicon: Lexicon
    trees: Trees
    steps: Isotonic

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.steps(self.trees.raw(x))


def _features(rows: DataFrame, pick) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and folds of training rows; ``pick(fold)`` is the lexicon to use."""

    def run(batches):
        flags = {f: Flags(pick(f)) for f in (0, 1)}
        for b in batches:
            folds = b.column("fold").to_pylist()
            x = [flags[f].features(raw) for f, raw in zip(folds, utf8(b.column("text")))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("y"), b.column("fold")], names=["x", "y", "fold"])

    got = map_arrow(rows.select("text", "y", "fold"), run, "x array<double>, y int, fold int").toArrow()
    return np.array(got.column("x").to_pylist(), float).reshape(-1, len(FEATURES)), got.column("y").to_numpy().astype(float), got.column("fold").to_numpy()


def _marks(totals: dict[int, tuple[int, int]], folds: tuple[int, ...]) -> Column:
    """What ``learn_lexicon`` asks of a term, so that no other one reaches the driver."""
    n1, n0 = (float(sum(totals.get(f, (0, 0))[k] for f in folds)) for k in (0, 1))
    a, b = (sum((F.col(f"{c}{f}") for f in folds[1:]), F.col(f"{c}{folds[0]}")) for c in "ab")
    return (a >= max(TERM_DOCS, TERM_SHARE * n1)) & (F.log((a + 0.5) / (n1 - a + 0.5)) - F.log((b + 0.5) / (n0 - b + 0.5)) > TERM_ODDS - 1e-6)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most ``train_rows`` labelled rows. Without rows of both labels every score is their rate."""
    written = Written(training_rows(docs, labels, "toxic", train_rows), "toxic")
    rows = written.df

    def count(batches):
        sides = [Counter() for _ in range(4)]  # others and toxic of fold 0, then of fold 1
        for b in batches:
            for y, f, text in zip(b.column("y").to_pylist(), b.column("fold").to_pylist(), decoded(b.column("text"))):
                sides[2 * f + y].update({t for w in set(text.split()) for t in terms_of(w)})
        some = list({*sides[1], *sides[3], *sides[0], *sides[2]})
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), *[pa.array([c[t] for t in some], pa.int64()) for c in sides]], names=["t", "b0", "a0", "b1", "a1"])

    totals = {r[0]: (r[1], r[2]) for r in rows.groupBy("fold").agg(F.count_if(F.col("y") == 1), F.count_if(F.col("y") == 0)).collect()}
    counts = map_arrow(rows.select("y", "fold", "text"), count, "t string, b0 bigint, a0 bigint, b1 bigint, a1 bigint")
    summed = counts.groupBy("t").agg(*[F.sum(c).alias(c) for c in ("b0", "a0", "b1", "a1")])
    best = summed.where(_marks(totals, (0,)) | _marks(totals, (1,)) | _marks(totals, (0, 1))).collect()
    found = [(r["t"], f, r[f"a{f}"], r[f"b{f}"]) for r in best for f in (0, 1)]
    across = {f: learn_lexicon(found, totals, (1 - f,)) for f in (0, 1)}
    x, y, fold = _features(rows, across.__getitem__)
    written.drop()
    trees = Trees().fit(x, y)
    raw = np.zeros(len(y))
    for f in (0, 1):
        raw[fold == f] = Trees().fit(x[fold != f], y[fold != f]).raw(x[fold == f])
    return Model(learn_lexicon(found, totals, (0, 1)), trees, Isotonic().fit(raw, y))


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score) of every row; null and empty texts are scored as no words, bytes
    that are not UTF-8 as U+FFFD.

    ``held_out`` is false for a null id. Repeated rows each get a row; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    picked = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def make():
        flags = Flags(sent.value.lexicon)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([flags.features(raw) for raw in utf8(batch.column("text"))], float).reshape(-1, len(FEATURES))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.score(x))], names=["doc_id", "score"])

        return work

    scored = map_batches(picked, make, f"doc_id {picked.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score")


def reject_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; columns and other rows stay."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        flags = Flags(sent.value.lexicon)
        for b in batches:
            x = np.array([flags.features(raw) for raw in utf8(b.column(names.index(text)))], float).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(sent.value.score(x) < threshold))

    return map_arrow(docs, run, docs.schema)
