import pytest


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text[, source]) tuples, with columns of other names beside them."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "s", 1, "x", 2) for r in rows]
        return spark.createDataFrame(full, "doc_id bigint, text string, source string, h bigint, digest string, pos int")

    return build


@pytest.fixture
def folder(spark):
    from extracteval.session import scratch_path

    return lambda: scratch_path(spark, "llm-tests")
