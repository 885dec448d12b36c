import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from lorekiln.session import local_session  # noqa: E402

DATA = Path(os.environ.get("LOREKILN_TESTDATA", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 2, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    if not DATA.exists():
        pytest.skip("no test tables")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for file in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con
