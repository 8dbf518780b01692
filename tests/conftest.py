import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

from loomgraph.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    folder = tmp_path_factory.mktemp("spark")
    SparkSession.builder.config("spark.checkpoint.dir", f"file://{folder}/shared").config("spark.sql.warehouse.dir", f"{folder}/warehouse").config("spark.driver.memory", "6g")
    s = session("tests", cores="4", partitions=4)
    s.conf.set("spark.sql.shuffle.partitions", "4")
    s.sparkContext.setLogLevel("ERROR")
    yield s


DATA = "/root/testdata"


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(f"{DATA}/sf0.001"):
        pytest.skip("no test tables")
    return f"{DATA}/sf0.001"
