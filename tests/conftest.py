import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sensorframe import model  # noqa: E402
from sensorframe.session import build_session  # noqa: E402

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", 8, app_name="sensorframe-tests",
                      extra={"spark.sql.maxMetadataStringLength": "10000"})
    yield s


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


@pytest.fixture
def facts_df(spark):
    def make(rows):
        return spark.createDataFrame([(ts(t) if isinstance(t, str) else t, v, i, ty) for t, v, i, ty in rows],
                                     model.FACT_SCHEMA)
    return make


@pytest.fixture
def meta_df(spark):
    def make(rows):
        return spark.createDataFrame(rows, model.META_SCHEMA)
    return make
