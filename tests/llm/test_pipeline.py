import subprocess
import sys

import corpus_pipeline as cp
from glosspark.llm import common, decontam, packing, pii
from glosspark.llm.common import table

from .test_decontam import brute as windows_of
from .test_simhash import brute_components


def test_stages_against_brute_force(spark, sf):
    docs = table(spark, sf, "documents")
    kept = cp.drop_toxic(spark, docs, sf)
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns and 0 < len(rows) < docs.count()

    one = cp.drop_near_duplicates(spark, kept, sf)
    _, comps = brute_components(rows)
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(comps)) and one.columns == docs.columns

    clean = cp.drop_contaminated(spark, one, sf)
    left = [(r.doc_id, r.text) for r in one.collect()]
    items = [(r.item_id, r.text) for r in table(spark, sf, "benchmark").collect()]
    assert sorted(r.doc_id for r in clean.collect()) == sorted(w[0] for w in windows_of(left, items) if not w[5])

    masked = cp.mask_personal_data(spark, clean, sf)
    before = {r.doc_id: r.text for r in clean.collect()}
    for r in masked.collect():
        assert r.text == pii.masked(before[r.doc_id].encode()) and r.n_chars == len(r.text)

    pieces = cp.pack_sequences(spark, masked, sf).collect()
    total = {}
    for p in pieces:
        total[p.doc_id] = total.get(p.doc_id, 0) + p.length
    assert total == {p.doc_id: p.doc_tokens for p in pieces} and set(total) == set(before)


def test_rows_without_ids_and_equal_ids(spark, docs):
    text = "one two three four five six seven"
    df = docs([(None, text), (5, text), (5, text), (None, "other words that stand alone here"), (7, "lone text of its own kind"), (None, None), (None, "")])
    got = cp.drop_near_duplicates(spark, df, "").collect()
    assert sorted((str(r.doc_id), r.text or "") for r in got) == sorted([("5", text), ("None", "other words that stand alone here"), ("7", "lone text of its own kind"), ("None", "")])


def test_empty_documents(spark, docs, sf):
    df = docs([])
    for _, stage in cp.STAGES:
        df2 = stage(spark, df, sf)
        assert df2.collect() == []


def test_run_and_stage_names(spark, sf):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "packing"]
    assert cp.run(spark, sf).count() > 0


def test_the_rest_stands_without_llm(tmp_path):
    """``__spark_entry__`` imports when the subpackage and the pipeline are gone."""
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('glosspark.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'quota_daily' in e.queries() and not any(n.startswith('op') and n[2].isdigit() for n in e.queries()) and 'pipeline' not in e.queries()\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=cp.__file__.rsplit("/", 1)[0], timeout=120)


def test_absence_hides_nothing_else():
    """Without the pipeline the operators stay; a library that is missing is a fault."""
    finder = "import sys, importlib.abc\nclass Gone(importlib.abc.MetaPathFinder):\n    def find_spec(self, name, path, target=None):\n        if name == {0!r}: raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, Gone())\n"
    run = lambda code: subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=cp.__file__.rsplit("/", 1)[0], timeout=120)
    alone = run(finder.format("corpus_pipeline") + "import __spark_entry__ as e\nq = e.queries()\nassert 'pipeline' not in q and 'op1_toxicity' in q and 'op3_warc_revisits' in e.oracle_sql()\n")
    assert alone.returncode == 0, alone.stderr
    fault = run(finder.format("xxhash") + "import __spark_entry__\n")
    assert fault.returncode != 0 and "xxhash" in fault.stderr


def test_texts_are_not_shuffled(spark, sf):
    docs = table(spark, sf, "documents")
    plan = cp.drop_near_duplicates(spark, docs, sf)._jdf.queryExecution().executedPlan().toString()
    for line in plan.splitlines():
        assert "Exchange hashpartitioning" not in line or "text#" not in line
    assert plan.count("FileScan parquet") == 2 and "SortMergeJoin" not in plan


def test_rows_beyond_the_maps_are_joined(spark, docs):
    df = docs([(i, f"text {i}") for i in range(100)])
    rows = common.Rows(df, "rows")
    gone = rows.marked().where("doc_id % 3 = 0").select(rows.file, rows.at)
    want = sorted((i, f"text {i}") for i in range(100) if i % 3)
    for most in (1 << 20, 0):
        assert sorted((r.doc_id, r.text) for r in rows.without(gone, most).collect()) == want
    assert rows.without(gone.limit(0)).count() == 100


def test_oracle_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert {f"op{n}" for n in range(1, 11)} <= {k.split("_")[0] for k in e.queries()}
    assert decontam.WINDOW == 10 and packing.WINDOW == 4096
