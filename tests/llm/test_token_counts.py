import random

from glosspark.llm import token_counts as tc

EXTRA = [(90, None), (91, ""), (92, " "), (93, "\n\n"), (94, "  two  blanks "), (95, "▁x ▁"), (96, "<s> </s> <unk>"), (97, "naïve 数 🙂\x00\r\t"), (98, "word " * 20_000), (98, "word " * 20_000), (None, "a b")]


def test_against_the_library(docs):
    rng = random.Random(0)
    alphabet = list("ab \n  ▁\tthe.,é中🙂") + ["<s>", " the", "ing "]
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))) for i in range(80)] + EXTRA
    processor = tc.load(tc.MODEL)
    assert tc.separable(processor)
    got = tc.count_tokens(docs(rows, extra=True), table_rows=10).collect()
    want = sorted((str(i), len((t or "").encode()), len(processor.encode(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want


def test_full_cache_starts_afresh():
    processor = tc.load(tc.MODEL)
    lengths = tc.Lengths(processor, {"a": 1}, cache_size=3)
    for t in ["one two three four five six", "six five a"]:
        assert lengths.count(t) == len(processor.encode(t))
    assert len(lengths) <= 4


def test_bytes_that_are_no_text(spark):
    df = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF2062' AS STRING) AS text")
    got = tc.count_tokens(df).first()
    assert (got.n_bytes, got.n_tokens) == (4, len(tc.load(tc.MODEL).encode("a\ufffd b")))


def test_long_keys_stay_out_of_the_cache():
    lengths = tc.Lengths(tc.load(tc.MODEL), {})
    lengths.count("short " + "x" * 500)
    assert set(lengths) == {"short"}


def test_empty_table(docs):
    assert tc.count_tokens(docs([])).collect() == []


def test_no_pretoken_is_shuffled(docs):
    plan = tc.count_tokens(docs([(1, "a b")]))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
