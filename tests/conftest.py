import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = os.environ.get("TEXTQUARRY_SMALL", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from textquarry.session import local_session

    session = local_session(8, 8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    return SMALL


@pytest.fixture(scope="session")
def duck(small):
    import glob

    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        name = os.path.basename(path)[:-8]
        source = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"create view {name} as select * from read_parquet('{source}')")
    return con


def comparable(columns, rows):
    """Rows with columns by name and floats rounded, in a fixed order."""
    import decimal
    import math

    def plain(v):
        if isinstance(v, decimal.Decimal):
            v = float(v)
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5) + 0.0
        return v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)
