import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from glosspark.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = [int(c) for c in m[0] if c in "0123456789"]
            if kind == "ip" and any(len(x.lstrip("0")) > 3 or int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card":
                total = sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(reversed(digits)))
                if not 13 <= len(digits) <= 19 or total % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans(docs):
    rng = random.Random(0)
    pieces = ["a.b@c-d.example", "@", "..", " ", "1.2.3.4", "300.1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (988) 555-2485", "+12", "é", "x@y", ".com", "0", "55", "+", "-", "\n", "数", "%"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "x " * 50_000 + "q@w.er"), (902, "9" * 5000), (None, "1.1.1.1"), (3, rows[3][1])]
    got = pii.digest(pii.find_pii(docs(rows, extra=True))).collect()
    want = sorted((str(i), hashlib.sha256(",".join(":".join(map(str, s)) for s in base(t)).encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.base_sha256) for r in got) == want
    plain = {(str(r.doc_id), r.base_sha256): r for r in got}
    for i, t in rows:
        spans = base(t)
        r = plain[str(i), hashlib.sha256(",".join(":".join(map(str, s)) for s in spans).encode()).hexdigest()]
        listed = r.spans.split(",") if r.spans else []
        assert {":".join(map(str, s)) for s in spans} <= set(listed)
        assert len(listed) == r.n_email + r.n_ip + r.n_card + r.n_phone


@pytest.mark.parametrize(
    ("kind", "hidden"),
    [
        ("email", "john.doe (at) example [dot] com"), ("email", "john dot doe at example dot com"), ("email", "jоhn@exаmple.com"), ("email", "jo​hn@example.com"), ("email", "mail{at}host.example"), ("email", "ａ＠ｂ．ｃｄ"),
        ("ip", "one nine two dot one six eight dot one dot one two"), ("ip", "10 dot 0 dot 0 dot 1"), ("ip", "１０.0.0.1"), ("card", "４１１１ １１１１ １１１１ １１１１"), ("card", "4l11 1111 1111 1111"), ("card", "4111 1111 1111 IIII"),
        ("card", "four one one one one one one one one one one one one one one one"), ("phone", "plus one five five five one two three four five six seven"), ("phone", "+1 555 five five five 1234"), ("email", "bosbt.42 @ mail8.example.com"), ("email", "a @ b . com"),
        ("email", "john_at_example_dot_com"), ("email", "juan arroba correo punto es"), ("phone", "plus drei vier sechs eins eins eins zwei zwei zwei"), ("card", "4111-1111-1111-lll1"), ("ip", "1[.]2[.]3[.]4"), ("ip", "one zero point zero point zero point one"), ("card", "4111\u00a01111\u00a01111\u00a01111"), ("card", "4111–1111–1111–1111"), ("phone", "+1 988 555‑2485"),
    ],
)
def test_disguises_map_back(kind, hidden):
    text = f"Étude: {hidden} – fin"
    assert (kind, hidden) in [(pii.KINDS[k], text[s:e]) for k, s, e, _ in pii.find(text.encode())]


@pytest.mark.parametrize("text", ["Call plus 1 (988) 555-2485 today", "PLUS\t1 988 555 2485", "mail a\t.\tb", "(one two)", "FÜNF FÜNF", "«zéro» ZÉRO un", "nine dot !", "dot one"])
def test_one_disguise_is_enough(text):
    assert pii.normalise(text).text != text and pii.disguised(text.encode())


def ungated(text):
    """``find`` with the transducers run on every text."""
    base, tape = pii.matches(text), pii.normalise(text)
    out = [(*m, True) for m in base]
    for kind, a, b in pii.matches(tape.text):
        span = (kind, tape.start[a], tape.end[b - 1])
        if (any(tape.new[a:b]) or span[2] - span[1] != b - a) and span not in base and not any(k == kind and x <= span[1] and span[2] <= y for k, x, y in base):
            out.append((*span, False))
    return sorted(out)


def test_find_runs_the_transducers_wherever_they_do_anything():
    rng = random.Random(11)
    digits = [w for w in pii.DIGITS if w.isascii()][:20] + ["oh"]
    parts = ["plus ", "Plus\t", "+", "44 20 7946 0958", "1 988 555 2485", "4l11 1111 1111 1111", "4111 1111 1111 lll1", "joe", "mail.example", "com", " at ", "_at_", " arroba ", " arobase ", " dot ", "-punkt-", " punto ", " point ", "(at)", "[ @ ]", "<dot>", "{.}",
             "&#64;", "&#x40;", "&commat;", "&#46;", "&#X2E;", "&period;", " @ ", "@ ", " . ", "1O.0.0.1", "10", ".", " ", ", ", "\u200b", "\u2013", "а", "５", "\u00ad", "\u00a0", "é"]
    found = 0
    for _ in range(20_000):
        text = "".join(rng.choice(parts) if rng.random() < 0.75 else " ".join(rng.choices(digits, k=rng.randint(1, 9))) for _ in range(rng.randint(1, 8)))
        got = pii.find(text.encode())
        assert got == ungated(text), text
        found += any(not base for *_, base in got)
    assert found > 1000
    for text, span in (("plus 44 20 7946 0958", "phone"), ("joe&#x40;mail.example", "email"), ("joe@mail&period;example", "email")):
        assert [pii.KINDS[k] for k, *_ in pii.find(text.encode())] == [span]


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'FFFE61406D2E6578' AS STRING) AS text")
    assert pii.digest(pii.find_pii(df)).first().spans == "email:2:8"
    assert pii.mask(df.withColumn("n_chars", F.lit(1))).first().text == "\ufffd\ufffd[EMAIL]"


def test_phone_after_the_word_plus():
    assert pii.find("Call plus 1 (988) 555-2485 today".encode()) == [(3, 5, 26, False)]
    assert pii.masked("Call plus 1 (988) 555-2485 today".encode()) == "Call [PHONE] today"


def test_not_disguised_means_nothing_to_rewrite():
    rng = random.Random(5)
    pieces = ["plus", "Plus", "one", "FÜNF", "zéro", "oh", "dot", "Punkt", "point", "at", "arroba", "@", ".", "com", "x", "É", "5", "12", "O", "l", "(", ")", "[", "]", " ", " ", "  ", "\t", "-", "_", ",", "/", "\n", "«", "×", "&#64;", "²", "\u00ad", "а"]
    seen = 0
    for _ in range(60_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 7)))
        if not pii.disguised(text.encode()):
            seen += 1
            assert pii.normalise(text).text == text, text
    assert seen > 10_000


def test_plain_words_are_left_alone():
    for text in ["we met at the dot of noon", "the two of us, one by one", "seven eight nine", "Привет мир", "look at this. At home", "version 2.0.1", "10 O1 l0", "un un un un " * 9, "dos o tres", "ends here . Com", "a point in time"]:
        assert [s for s in pii.find(text.encode()) if not s[3]] == []


def test_tape_maps_every_character():
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(["one ", "two ", " (at) ", "[dot]", "а", "​", "x", "5", "l", " dot ", "plus "]) for _ in range(12))
        tape = pii.normalise(text)
        assert len(tape.text) == len(tape.start) == len(tape.end) == len(tape.new)
        for c, s, e, new in zip(tape.text, tape.start, tape.end, tape.new):
            assert 0 <= s < e <= len(text) and (new or text[s:e] == c)
        assert list(tape.start) == sorted(tape.start)


def test_mask(docs):
    df = docs([(1, "to a@b.cd and 1.2.3.4"), (2, None), (3, "none")]).withColumn("tag", F.lit("t"))
    got = {r.doc_id: r for r in pii.mask(df).collect()}
    assert got[1].text == "to [EMAIL] and [IP]" and got[1].n_chars == len(got[1].text)
    assert got[2].text is None and got[3].text == "none" and got[3].tag == "t"
    assert pii.mask(docs([])).collect() == [] and pii.find_pii(docs([])).collect() == []
