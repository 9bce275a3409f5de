import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) pairs or from texts, with columns whose names clash with inner ones."""

    def build(rows, parts=3):
        rows = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        full = [(i, t, "en", "s", len(t or "")) for i, t in rows]
        df = spark.createDataFrame(full, DOCS).repartition(parts)
        # names that the operators use inside
        for name in ("id", "n", "key", "row", "words", "score", "kind", "block", "rep", "comp", "spans", "ids"):
            df = df.selectExpr("*", f"'x' as `{name}`")
        return df

    return build
