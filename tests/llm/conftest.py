import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Makes a frame like ``documents`` of (doc_id, text) rows, with columns that clash with the operators' own."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows], DOCS)
        if extra:
            for name in ("fp", "start", "spans", "score", "n_words", "hits", "items", "component_id", "kind", "query_id", "v", "host", "slot", "b", "__text"):
                df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make
