"""Main text of web pages by equivalence classes of tokens across same-host pages.

A page's tokens are its elements and its text blocks. An element's token is its role: the path of
tags and class words (numbers folded) in which a box also has its place among equal siblings, and
one without classes the kind of its first child. A token's occurrence vector has its count on every page of the
host. Tokens of one host with equal vectors form an equivalence class; equality is decided on a
64-bit linear sketch (sum over pages of count x hash of the page), so vectors are never gathered and
a host with a third of the pages is only more rows to add up. The class that stands once on each
page is the skeleton; classes that support most pages are valid, and nest below the skeleton role
that contains them.

Roles are then told apart further by the classes: on hosts where pages differ in how many boxes of
one role they have, places beside skeleton elements are counted anew from the last of these, and the
classes with them, until no host gains an element to count from (``ROUNDS`` at most).

What lies between template tokens are slots. The main slot is found from the root downwards: of an
element's boxes in valid classes those of links, of constant text, and sets of equal boxes beside
the main one (comments, teasers) are cut, and the way goes on into a box that holds most of
the varying text left, unless a heading would stay outside. A second pass extracts each page's
main slot without the cuts; where no element marks the slot off from the page, constant blocks go too.

A host with one page, or a page without its host's main slot, is judged by itself: an article or
main element if there is one, else the body. Elements and class words that never are main text
(menus, forms, scripts) go everywhere.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosspark.llm.common import Written, decoded, map_arrow

#: Share of a host's pages that a valid class must support, and of varying text that the main slot must hold.
SUPPORT, MASS = 0.5, 0.8
#: A box is cut beside the main slot if so much of its text is links or lies in equal boxes, or so little of it varies.
CUT, VARYING = 0.5, 0.1
#: How often roles are told apart at most; hosts that a round leaves as they are have no further one.
ROUNDS = 3
#: Templates are broadcast up to this many bytes and joined by host beyond.
BROADCAST_BYTES = 32 << 20

_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_CLASS = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_NUMBER = re.compile(r"\d+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes textarea title noscript".split())
_UNSEEN = frozenset("script style noscript template title meta link base".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_SCOPE = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}
#: Elements that are never main text. A header within an article is its heading.
NEVER = frozenset("nav aside footer form script style noscript template iframe svg button select textarea dialog object canvas audio video head title menu".split())
#: Class, id or role words that mark the same: alone, or joined to one another or to a word that only says where or what box it is.
NEVER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay "
    "newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments reply replies disqus share sharing social related "
    "recommended footer pagination pager toolbar widget skip hidden masthead search login contentinfo complementary".split()
)
PLACE_WORDS = frozenset(
    "site page post article top bottom left right main global primary secondary box block container wrap wrapper area section list item items bar row col column slot unit zone "
    "posts links link buttons button icons form field message text content panel inner outer header heading title count thread js".split()
)
_WORD = re.compile(r"[a-z]+")
_ABOUT = re.compile(r"(?:has|no|with|without|hide|show)[-_]|.*[-_]with[-_]")  # what a class says of its neighbours
_ROOTS = ("article", "main")
#: Elements that hold blocks: slots end at them, never within a paragraph.
BOXES = frozenset("html body div section article main td center".split())


class Page:
    """A page's elements in order (element 0 holds all) and its runs of text: (element, dropped, text, breaks).

    ``dropped`` if the run is never main text, ``breaks`` if a block starts before it.
    """

    __slots__ = ("parent", "label", "name", "kind", "runs")

    def __init__(self, html: str):
        self.parent, self.label, self.name, self.kind, self.runs = [0], [""], [""], [""], []
        self._read(html)

    def _read(self, html: str) -> None:
        own: list[int] = [0]  # open elements
        names: list[str] = [""]
        drops: list[bool] = [False]
        at, breaks, size = 0, True, len(html)
        find = _TAG.search
        while at < size:
            m = find(html, at)
            text = html[at : m.start() if m else size]
            if not m and (cut := text.rfind("<")) >= 0 and re.match(r"<[/!?A-Za-z]", text[cut:]):
                text = text[:cut]  # a tag that the page's end cut off
            if text:
                self.runs.append((own[-1], drops[-1], text, breaks))
                breaks = False
            if not m:
                return
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if name not in _INLINE and name not in _UNSEEN:
                breaks = True
            if m[1]:
                if name in names:
                    while names.pop() != name:
                        own.pop(), drops.pop()
                    own.pop(), drops.pop()
                continue
            if name in _VOID:
                if self.kind[own[-1]] == "" and name in ("img", "hr"):
                    self.kind[own[-1]] = "prose"
                continue
            if name in _CLOSES_P and "p" in names:
                k = len(names) - 1 - names[::-1].index("p")
                if not any(n in ("table", "td", "th", "button", "object") for n in names[k + 1 :]):
                    del names[k:], own[k:], drops[k:]
            for same in _SAME.get(name, ()):
                k = len(names) - 1
                while k >= 0 and names[k] != same and names[k] not in _SCOPE[name]:
                    k -= 1
                if k >= 0 and names[k] == same:
                    del names[k:], own[k:], drops[k:]
            attrs = m[3]
            label, drop = name, drops[-1] or name in NEVER or (name == "header" and not any(n in _ROOTS for n in names))
            if attrs:
                words = [w for c in _CLASS.findall(attrs) for w in "".join(c).lower().split()]
                if words and name not in ("html", "body"):
                    label = name + "." + ".".join(sorted(_NUMBER.sub("0", w).replace("/", "_") for w in words))
                    drop = drop or (name not in _ROOTS and any(map(never_word, words)))
                drop = drop or bool(_HIDDEN.search(attrs))
            if attrs and attrs.rstrip().endswith("/") and name in ("svg", "path"):
                continue
            if name in _RAW:
                stop = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
                at = stop.start() if stop else size
                if not stop:
                    return
                close = html.find(">", at)
                at = close + 1 if close >= 0 else size
                continue
            up = own[-1]
            if self.kind[up] == "" and name not in _INLINE:
                self.kind[up] = "box" if name in BOXES else "list" if name in ("ul", "ol", "nav", "menu", "dl") else "prose"
            own.append(len(self.parent)), names.append(name), drops.append(drop)
            self.parent.append(up), self.label.append(label), self.name.append(name), self.kind.append("")

    def steps(self) -> list[str]:
        """What each element is beneath its parent: its label and, for a box without classes, the kind of its first child."""
        return [f"{a}:{k}" if k and a == n and n in BOXES and n not in ("html", "body") else a for a, n, k in zip(self.label, self.name, self.kind)]

    def roles(self, known: tuple[frozenset[str], ...] = ()) -> tuple[list[str], dict[str, int]]:
        """Each element's role, and how many boxes share a role but for their place. The skeletons that earlier rounds
        found (``known``) tell places apart anew, one after another."""
        steps, roles = self.steps(), [""] * len(self.parent)
        for k in range(len(known) + 1):
            before, anchors = (roles, known[k - 1]) if k else ([], frozenset())
            roles = [""] * len(self.parent)
            last: dict[int, str] = {}  # parent -> its last skeleton child
            placed: dict[tuple[int, str], int] = {}
            for i in range(1, len(roles)):
                up, step = self.parent[i], steps[i]
                if k and before[i] in anchors:
                    step = before[i].rpartition("/")[2]
                    last[up] = step.partition("@")[0]
                elif self.name[i] in BOXES:
                    if up in last:
                        step = f"{step}@{last[up]}"
                    n = placed[up, step] = placed.get((up, step), 0) + 1
                    step = f"{step}~{n}" if n > 1 else step
                roles[i] = f"{roles[up]}/{step}" if roles[up] else step
        alike: dict[str, int] = {}
        for (up, step), n in placed.items():
            role = f"{roles[up]}/{step}" if roles[up] else step
            alike[role] = alike.get(role, 0) + n
        return roles, alike


def never_word(word: str) -> bool:
    """Whether a class word marks what is never main text; "ad-hoc" and "search-theory" mark nothing."""
    if _ABOUT.match(word):
        return False
    parts = _WORD.findall(word)
    return any(p in NEVER_WORDS for p in parts) and all(p in NEVER_WORDS or p in PLACE_WORDS for p in parts)


def joined(runs: list[tuple[str, bool]]) -> str:
    """Text of runs: references decoded, white space to one space, blocks joined by one space."""
    return " ".join(unescape("".join([" " + t if b else t for t, b in runs])).split())


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _wrap(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


STATS = ("chars", "links", "heads", "sets")
#: Ends the token that counts boxes of one role in any place.
ANY = "~*"


class Token(NamedTuple):
    """A host's token: a role, or a block of text in it, with its occurrence vector's pages, sum and
    sketch, and the characters of its text: all, in links, in headings, in boxes that have equals beside them."""

    path: str
    block: int | None
    df: int
    n: int
    sketch: object
    chars: int
    links: int
    heads: int
    sets: int


def page_tokens(html: str, known: tuple[frozenset[str], ...] = ()) -> dict[tuple[str, int | None], list[int]]:
    """(role, hash of block or null) -> [count, characters of text that may be main: all, in links, headings, sets] of
    one page. The empty role stands once and holds all; no block is a token within articles."""
    page = Page(html)
    (roles, alike), parent, name = page.roles(known), page.parent, page.name
    size = len(roles)
    out: dict[tuple[str, int | None], list[int]] = {}
    below = [[0, 0, 0, 0] for _ in range(size)]
    in_link, in_head, in_root, home = [False] * size, [False] * size, [False] * size, [0] * size
    for i in range(1, size):
        up = parent[i]
        in_link[i], in_head[i], in_root[i] = in_link[up] or name[i] == "a", in_head[up] or name[i] in ("h1", "h2"), in_root[up] or name[i] in _ROOTS
        home[i] = home[up] if name[i] in _INLINE else i
    texts: dict[int, list[str]] = {}
    for i, dropped, text, _ in page.runs:
        if text.isspace():
            continue
        n = len(text)
        if not dropped:
            b = below[i]
            b[0] += n
            b[1] += n * in_link[i]
            b[2] += n * in_head[i]
        if not in_root[i]:
            texts.setdefault(home[i], []).append(text)
    steps = page.steps()
    for i in range(size - 1, 0, -1):  # children come after their parents
        a, b = below[parent[i]], below[i]
        a[0] += b[0]
        a[1] += b[1]
        a[2] += b[2]
    equal: dict[tuple[int, str], list[int]] = {}
    for i in range(1, size):
        if name[i] in BOXES or name[i] == "li":
            equal.setdefault((parent[i], steps[i]), []).append(below[i][0])
    for (up, _), sizes in equal.items():
        if len(sizes) > 1:
            below[up][3] += sum(sizes)
    for role, b in zip(roles, below):
        t = out.get((role, None))
        if t is None:
            out[role, None] = [1, *b]
        else:
            t[0] += 1
            for k in range(4):
                t[k + 1] += b[k]
    for role, n in alike.items():
        out[role + ANY, None] = [n, 0, 0, 0, 0]
    for i, runs in texts.items():
        t = out.setdefault((roles[i], _hash(" ".join("".join(runs).split()))), [0, 0, 0, 0, 0])
        t[0] += 1
        t[1] += sum(map(len, runs))
    return out


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^(?:[A-Za-z]+://)?([^/?#]*)", 1))


_SUMS = ("df", "n", "sketch", *STATS)


def token_vectors(pages: DataFrame, found: Found | None = None) -> DataFrame:
    """(host, path, block, df, n, sketch, chars, links, heads, sets) of each token over all pages of a host;
    ``block`` is null for a role. Added up in the reading task first, then by host and token.

    ``found`` has the templates of an earlier round; pages of hosts without one are left out then.
    """
    marked = pages.select("host", F.xxhash64("html").alias("mark"), "html")
    rows, lookup = found.beside(marked) if found else (marked, None)

    def run(batches):
        sums: dict[tuple, list[int]] = {}

        def flush():
            keys, vals = list(sums), list(sums.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.int64()), *[pa.array([v[i] for v in vals], pa.int64()) for i in range(len(_SUMS))]],
                names=["host", "path", "block", *_SUMS],
            )
            sums.clear()

        for batch in batches:
            plans = lookup(batch) if lookup else [NO_TEMPLATE] * batch.num_rows
            for host, mark, text, plan in zip(batch.column("host").to_pylist(), batch.column("mark").to_pylist(), decoded(batch.column("html")), plans):
                if plan is None:
                    continue
                for (path, block), (n, *stats) in page_tokens(text or "", plan.known).items():
                    key = (host, path, block)
                    s = sums.get(key)
                    if s is None:
                        s = sums[key] = [0] * len(_SUMS)
                    s[0] += 1
                    s[1] += n
                    s[2] = _wrap(s[2] + n * mark)
                    for k, v in enumerate(stats, 3):
                        s[k] += v
                if len(sums) > 100_000:
                    yield from flush()
        yield from flush()

    part = map_arrow(rows, run, "host string, path string, block bigint, " + ", ".join(f"{c} bigint" for c in _SUMS))
    # sums modulo 2^64, which a long cannot overflow to: by halves
    low, high = F.sum(F.col("sketch").bitwiseAND(F.lit(0xFFFFFFFF))).cast("decimal(38,0)"), F.sum(F.shiftright("sketch", 32)).cast("decimal(38,0)")
    wrapped = F.pmod(low + high * F.expr("4294967296BD"), F.expr("18446744073709551616BD"))
    return part.groupBy("host", "path", "block").agg(*[wrapped.alias(c) if c == "sketch" else F.sum(c).alias(c) for c in _SUMS])


def nested(tokens: list[Token], pages: int) -> tuple[frozenset[str], dict[str, list[str]]]:
    """The skeleton (roles that stand once on every page) and, below each of its roles, the roles of
    other valid classes that it is the deepest to hold.

    Equal (df, n, sketch) is one occurrence vector, hence one class; the skeleton's is that of the
    empty role, which every page has once.
    """
    classes: dict[tuple, list[str]] = defaultdict(list)
    top = None
    for t in tokens:
        if t.block is None and not t.path.endswith(ANY):
            classes[t.df, t.n, t.sketch].append(t.path)
            if not t.path:
                top = (t.df, t.n, t.sketch)
    skeleton = frozenset(classes.get(top, ()))
    below: dict[str, list[str]] = defaultdict(list)
    for vector, paths in classes.items():
        if vector != top and vector[0] >= SUPPORT * pages:
            shared = os.path.commonprefix([p.split("/") for p in paths])
            while shared and "/".join(shared) not in skeleton:
                shared.pop()
            below["/".join(shared)] += paths
    return skeleton, below


class Template(NamedTuple):
    """One host's template: the main slot (a role, or None), the roles cut from it, its constant blocks
    ('role hash'), and the skeletons that its roles rest on, one for each earlier round."""

    slot: str | None = None
    cuts: frozenset[str] = frozenset()
    blocks: frozenset[str] = frozenset()
    known: tuple[frozenset[str], ...] = ()


NO_TEMPLATE = Template()


def _parent(role: str) -> str:
    return role.rpartition("/")[0]


def _name(role: str) -> str:
    return re.split("[.:@~]", role.rpartition("/")[2], maxsplit=1)[0]


def deduce(tokens: list[Token], pages: int, known: tuple[frozenset[str], ...] = ()) -> tuple[Template, frozenset[str]]:
    """The template of one host's tokens, which need be no more than those of valid classes, and the
    skeleton's roles beside which places vary, if a further round may tell more roles apart by them.

    Slots are the boxes of the skeleton and of nested classes that stand at most once on a page.
    """
    skeleton, below = nested(tokens, pages)
    stats = {t.path: t for t in tokens if t.block is None}
    single = {p for p, t in stats.items() if t.n == t.df and not p.endswith(ANY)}
    boxes = [p for p in [*skeleton, *(p for paths in below.values() for p in paths)] if p in single and _name(p) in BOXES]
    kids: dict[str, list[str]] = defaultdict(list)
    for p in sorted(boxes):
        kids[_parent(p)].append(p)
    one = int(stats[""].sketch) if "" in stats else 0
    loose = {p for p, t in stats.items() if p.endswith(ANY) and (t.df < pages or t.n % pages or (t.n // pages * one - int(t.sketch)) % (1 << 64))}  # as many on each page they are not
    unsure = {_parent(p) for p in loose}
    firm = {p for p in skeleton if p and _parent(p) in unsure and _name(p) not in _INLINE and re.sub(r"~\d+$", "", p) + ANY not in loose}
    before = known[-1] if known else frozenset()
    ahead = firm | before if firm - before else frozenset()
    constant: dict[str, int] = defaultdict(int)  # characters of constant text at or below a role
    for t in tokens:
        if t.block is not None and t.df >= max(2, SUPPORT * pages):
            at = t.path
            while True:
                constant[at] += t.chars
                if not at:
                    break
                at = _parent(at)
    varying = lambda p: max(0, stats[p].chars - constant[p])
    at, cuts = "", frozenset()
    while at in stats and varying(at):
        own = [p for p in kids[at] if stats[p].chars]
        plain = [p for p in own if stats[p].links < CUT * stats[p].chars and varying(p) >= VARYING * stats[p].chars]
        lone = [p for p in plain if stats[p].sets < CUT * stats[p].chars]
        main = max(lone, key=varying, default=None)
        if main is None or varying(main) < (1 - MASS) * varying(at):
            main = max(plain, key=varying, default=None)  # sets alone: the text itself is one, if it is most of it
            main = main if main and varying(main) >= CUT * varying(at) else None
        kept = [p for p in lone if p != main and main is not None or main is None]
        gone = [p for p in own if p != main and p not in kept]
        left = varying(at) - sum(map(varying, gone))
        outside = stats[at].heads - (stats[main].heads if main else 0) - sum(stats[p].heads for p in gone)
        if main and varying(main) >= MASS * left and outside < CUT * max(1, stats[at].heads):
            at = main
            continue
        cuts = frozenset(gone)
        break
    slot = at or None
    if slot:
        parts = slot.split("/")
        around = {r: p for k in range(len(parts), 0, -1) if (r := _name(parts[k - 1])) in _ROOTS and (p := "/".join(parts[:k])) in single}  # the outermost of each
        if around:  # main text as a whole
            slot, cuts = next(around[r] for r in _ROOTS if r in around), frozenset()
    whole = slot is None or _name(slot) in ("html", "body")  # no element marks the slot off
    blocks = frozenset(f"{t.path} {t.block}" for t in tokens if whole and t.block is not None and t.df >= max(2, SUPPORT * pages))
    return Template(slot, cuts, blocks, known), frozenset(ahead)


class Found:
    """Templates by host as a written table (host, slot, cuts, blocks, known, ahead), brought to rows of pages: broadcast
    if small as measured, else joined by host."""

    COLUMNS = "host string, slot string, cuts array<string>, blocks array<string>, known array<array<string>>, ahead array<string>"

    def __init__(self, df: DataFrame, label: str, broadcast_bytes: int = BROADCAST_BYTES):
        self.written, self.bytes = Written(df, label), broadcast_bytes
        self.df = self.written.df

    @staticmethod
    def _template(slot, cuts, blocks, known) -> Template:
        return Template(slot, frozenset(cuts or ()), frozenset(blocks or ()), tuple(map(frozenset, known or ())))

    def beside(self, rows: DataFrame):
        """``rows`` (with a host) and a function from their batches to templates; None where a host has none."""
        flat = lambda c: F.octet_length(F.array_join(c, " "))
        size = self.df.agg(F.sum(F.octet_length("host") + flat("cuts") + flat("blocks") + flat(F.flatten("known")) + 64)).first()[0] or 0
        if size <= self.bytes:
            sent = rows.sparkSession.sparkContext.broadcast({r[0]: self._template(*r[1:5]) for r in self.df.collect()})
            return rows, lambda batch: [sent.value.get(h) for h in batch.column("host").to_pylist()]
        joined_rows = rows.join(self.df.select("*", F.lit(True).alias("has")), "host", "left").select(*rows.columns, "slot", "cuts", "blocks", "known", "has")
        template = self._template
        read = lambda batch: [template(*t) if has else None for *t, has in zip(*[batch.column(c).to_pylist() for c in ("slot", "cuts", "blocks", "known", "has")])]
        return joined_rows, read

    def drop(self) -> None:
        self.written.drop()


def _round(pages: DataFrame, before: Found | None) -> DataFrame:
    """Templates of every host with two different pages or more; of those that ``before`` has, in a further round."""
    tokens = Written(token_vectors(pages, before), "tokens").df  # read twice
    counts = tokens.where("path = '' and block is null").select("host", F.col("df").alias("pages"))
    valid = tokens.join(counts, "host").where((F.col("pages") >= 2) & (F.col("df") >= F.col("pages") * SUPPORT) & (F.col("block").isNull() | (F.col("df") >= 2)))  # no other token is in a valid class
    if before:
        valid = valid.join(before.df.select("host", "known"), "host")
    else:
        valid = valid.withColumn("known", F.lit(None).cast("array<array<string>>"))

    def one(key, held):
        known = tuple(map(frozenset, held.column("known")[0].as_py() or ()))
        rows = map(Token._make, zip(*[held.column(c).to_pylist() for c in Token._fields]))
        t, ahead = deduce(list(rows), held.column("pages")[0].as_py(), known)
        texts = pa.list_(pa.string())
        return pa.table({
            "host": [key[0].as_py()], "slot": pa.array([t.slot], pa.string()), "cuts": pa.array([sorted(t.cuts)], texts), "blocks": pa.array([sorted(t.blocks)], texts),
            "known": pa.array([[sorted(k) for k in known]], pa.list_(texts)), "ahead": pa.array([sorted(ahead)], texts),
        })

    return valid.groupBy("host").applyInArrow(one, Found.COLUMNS)


def _different(pages: DataFrame, broadcast_bytes: int) -> DataFrame:
    """``pages`` (host, html) without repeats. Only pages whose hash occurs again on their host are dealt out."""
    marked = pages.withColumn("mark", F.xxhash64("html"))
    again = Written(marked.groupBy("host", "mark").count().where("count > 1").select("host", "mark"), "copies").df
    n, size = again.agg(F.count("*"), F.sum(F.octet_length("host") + 16)).first()
    if not n:
        return pages
    again = F.broadcast(again) if size <= broadcast_bytes else again
    copies = marked.join(again, ["host", "mark"], "left_semi").select("host", "html").distinct()
    return marked.join(again, ["host", "mark"], "left_anti").select("host", "html").unionByName(copies)


def templates(pages: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, rounds: int = ROUNDS) -> Found:
    """Templates of the hosts in ``pages`` (host, html); copies of a page count once."""
    own = _different(pages.select("host", "html"), broadcast_bytes)
    found = Found(_round(own, None), "templates", broadcast_bytes)
    for _ in range(rounds - 1):
        again = found.df.where(F.array_size("ahead") > 0).withColumn("known", F.concat("known", F.array("ahead")))
        if again.isEmpty():
            break
        before = Found(again, "known", broadcast_bytes)
        new = Written(_round(own, before), "round")
        after = Found(found.df.join(new.df.select("host"), "host", "left_anti").unionByName(new.df), "templates", broadcast_bytes)
        for old in (found, before, new):
            old.drop()
        found = after
    return found


def main_text(html: str, template: Template | None) -> str:
    """The page's text in its host's main slot, or by the page alone if it has no text there."""
    page = Page(html)
    size = len(page.parent)
    template = template or NO_TEMPLATE
    slot, cuts = template.slot, template.cuts
    in_slot, cut, constant = [False] * size, [False] * size, [False] * size
    if slot or cuts or template.blocks:
        roles, _ = page.roles(template.known)
        for i in range(1, size):
            up = page.parent[i]
            in_slot[i], cut[i] = in_slot[up] or roles[i] == slot, cut[up] or roles[i] in cuts
        if template.blocks:
            home, texts = [0] * size, {}
            rooted = [False] * size
            for i in range(1, size):
                up = page.parent[i]
                home[i], rooted[i] = home[up] if page.name[i] in _INLINE else i, rooted[up] or page.name[i] in _ROOTS
            for i, _, text, _ in page.runs:
                if not rooted[i] and not text.isspace():
                    texts.setdefault(home[i], []).append(text)
            same = {i for i, runs in texts.items() if f"{roles[i]} {_hash(' '.join(''.join(runs).split()))}" in template.blocks}
            constant = [h in same for h in home]

    def text_of(inside: list[bool] | None, but: list[bool]) -> str:
        out, gap = [], False
        for i, dropped, text, b in page.runs:
            if dropped or but[i] or not (inside is None or inside[i]):
                gap = gap or b
            else:
                out.append((text, b or gap))
                gap = False
        return joined(out)

    but = [a or b for a, b in zip(cut, constant)]
    under: dict[str, list[bool]] = {}
    for root in _ROOTS:
        inside = under[root] = [False] * size
        for i in range(1, size):
            inside[i] = inside[page.parent[i]] or page.name[i] == root
    root = next((r for r in _ROOTS if any(under[r][i] and not dropped for i, dropped, _, _ in page.runs)), None)
    if slot and (root is None or root in map(_name, _ups(slot))):
        text = text_of(in_slot, but)
        if text:
            return text
    if root:
        text = text_of(under[root], constant)
        if text:
            return text
    return text_of(None, but) or text_of(None, [False] * size)  # nothing but template text: all of it


def _ups(role: str) -> Iterator[str]:
    while role:
        yield role
        role = _parent(role)


def extract_main(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", broadcast_bytes: int = BROADCAST_BYTES, rounds: int = ROUNDS) -> DataFrame:
    """(page_id, url, text) of every page; null or empty html gives an empty text.

    Bytes that are not UTF-8 are read as U+FFFD. Pages with a null url share the empty host. Repeated
    rows each get a row. Other columns are not read. An empty table gives no rows.
    """
    own = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").cast("string").alias("url"), F.col(f"`{html}`").cast("string").alias("html")).withColumn("host", host_of(F.col("url")))
    kind = own.schema["page_id"].dataType.simpleString()
    rows, lookup = templates(own, broadcast_bytes, rounds).beside(own.select("page_id", "url", "host", "html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(text, plan) if text else "" for text, plan in zip(decoded(batch.column("html")), lookup(batch))]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return map_arrow(rows, run, f"page_id {kind}, url string, text string")
