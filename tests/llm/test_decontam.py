import hashlib
import random
import re

from glosspark.llm import decontam as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, items):
    words = lambda t: WORD.findall((t or "").translate(LOWER))
    windows = set()
    for i, t in items:
        w = words(t)
        if i is not None and w:
            windows |= {(i, tuple(w[k : k + 10])) for k in range(max(1, len(w) - 9))}
    out = []
    for i, t in rows:
        w = words(t)
        hit, found = set(), set()
        for item, win in windows:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found.add(item)
        ids = ",".join(sorted(map(str, found)))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def corpus(seed=0):
    rng = random.Random(seed)
    vocab = ["the", "a", "of", "Éa", "x1", "zzz", "über", "Rare", "b-c", "q"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 4, 5, 9, 10, 14, 30])))) for i in range(25)]
    items += [(5, items[5][1]), (40, items[7][1]), (41, None), (42, " .,"), (None, "the a of")]
    rows = []
    for i in range(60):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 60))]
        if i % 2:
            src = rng.choice(items[:25])[1].split()
            at = rng.randint(0, len(w))
            w[at:at] = src[: rng.randint(1, len(src))]
        rows.append((i, ", ".join(w).upper() if i % 5 == 0 else " ".join(w)))
    return rows + [(90, None), (91, ""), (92, "the the"), (3, rows[3][1]), (None, rows[1][1]), (93, "the a of " * 8000)], items


def test_against_brute_force(spark, docs):
    rows, items = corpus()
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = d.digest(d.decontaminate(docs(rows, extra=True), bench)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, items)
    assert any(r.contaminated for r in got) and not all(r.contaminated for r in got)


def test_joined_instead_of_broadcast(spark, docs):
    rows, items = corpus(1)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = d.digest(d.decontaminate(docs(rows), bench, block_bytes=300)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, items)
    whole = {(r.doc_id, r.n_words): (r.hits, r.items) for r in d.decontaminate(docs(rows), bench).collect()}
    assert whole == {(r.doc_id, r.n_words): (r.hits, r.items) for r in d.decontaminate(docs(rows), bench, block_bytes=300).collect()}
    kept = d.reject_contaminated(docs(rows), bench, block_bytes=300)
    want = [r for r in brute(rows, items) if not r[5]]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(w[0]) for w in want)
    assert kept.columns == docs(rows).columns


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.decontaminate(docs([]), none).collect() == []
    assert [tuple(r) for r in d.digest(d.decontaminate(docs([(1, "a b")]), none)).collect()] == [(1, 2, 0, 0, d.sha256_of([]), False)]


def test_ids_that_are_strings_and_bytes_that_are_no_text(spark, docs):
    bench = spark.createDataFrame([("q1", "one two three"), ("q2", "four")], "item_id string, text string")
    df = spark.sql("SELECT 'd' AS doc_id, CAST(X'6F6E652074776F2074687265652061FF' AS STRING) AS text")
    for most in (d.BLOCK_BYTES, 5):
        got = d.decontaminate(df, bench, block_bytes=most).first()
        assert (got.n_words, [tuple(h) for h in got.hits], got["items"]) == (4, [(0, 3)], ["q1"])
        assert d.reject_contaminated(df, bench, block_bytes=most).count() == 0


def test_many_copies_of_a_passage(spark, docs):
    passage = " ".join(f"w{k}" for k in range(12))
    rows = [(i, passage if i % 3 == 0 else f"other text number {i}") for i in range(3000)]
    bench = spark.createDataFrame([(k, f"item {k} " + (passage if k < 3 else " ".join(f"x{k}y{j}" for j in range(30)))) for k in range(60)], "item_id bigint, text string")
    for most in (d.BLOCK_BYTES, 100):
        got = d.digest(d.decontaminate(docs(rows), bench, block_bytes=most)).groupBy("n_hit", "n_items").count().collect()
        assert sorted(map(tuple, got)) == [(0, 0, 2000), (12, 3, 1000)]
