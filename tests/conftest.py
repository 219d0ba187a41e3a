import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (str(ROOT), os.environ.get("PYTHONPATH", "")) if x)

from gneiss.catalog import TABLES  # noqa: E402
from gneiss.session import EngineConfig, session  # noqa: E402

DATA = os.environ.get("GNEISS_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark():
    config = EngineConfig(extra={"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.ansi.doubleQuotedIdentifiers": "false"})
    out = session("tests", "local[4]", config)
    out.sparkContext.setLogLevel("ERROR")
    yield out


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def oracle(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con
