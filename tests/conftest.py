import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(p for p in (ROOT, os.environ.get("PYTHONPATH", "")) if p)
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tarnloom.session import get_spark

    session = get_spark("tests", **{"spark.master": "local[8]", "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.codegen.wholeStage": os.environ.get("TEST_WHOLE_STAGE", "false"), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def frame(spark):
    """frame(rows, ddl): a small DataFrame."""
    return lambda rows, ddl: spark.createDataFrame(rows, ddl)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
