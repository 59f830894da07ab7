import pytest


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source) rows, with columns whose names clash with the operators' own."""

    def make(*rows):
        full = [(*r, *([None, None] if len(r) == 2 else [])) for r in rows]
        df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string").selectExpr("*", "length(text) AS n_chars")
        return df.selectExpr("*", *[f"'x' AS `{c}`" for c in ("key", "size", "w", "tid", "rid", "n", "SHARD", "target", "copies", "a.b")])

    return make


@pytest.fixture
def rows():
    """The rows of a frame as sorted tuples."""
    return lambda df, *columns: sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
