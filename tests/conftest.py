import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture
def value(spark):
    """The value of a column expression over literals."""
    def of(make, *args):
        from pyspark.sql import functions as F

        schema = ", ".join(f"c{i} {'int' if isinstance(a, int) and not isinstance(a, bool) else 'array<string>' if isinstance(a, list) else 'string'}" for i, a in enumerate(args))
        return spark.createDataFrame([tuple(args)], schema).select(make(*(F.col(f"c{i}") for i in range(len(args)))).alias("v")).first()["v"]

    return of
