import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from extracteval.session import get_spark  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


ATTRS = "qid bigint, pos int, attribute_key string, value string, key_priority int, attribute_priority int"


@pytest.fixture
def attrs(spark):
    """Build an attribute relation from (qid, key, value[, kp, ap]) tuples."""

    def build(rows):
        seen, out = {}, []
        for qid, key, value, *prio in rows:
            seen[qid] = seen.get(qid, 0) + 1
            kp, ap = prio or (1, seen[qid])
            out.append((qid, seen[qid], key, value, kp, ap))
        return spark.createDataFrame(out, ATTRS)

    return build
