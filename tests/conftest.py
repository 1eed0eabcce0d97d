import os
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from chorale.session import get_session  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")


@pytest.fixture(scope="session")
def sf_dir():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    """Sorted rows with columns by name; floats rounded, nulls alike."""

    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if isinstance(v, list | tuple):
            return tuple(plain(x) for x in v)
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
            return None
        return round(v, 6) + 0.0 if isinstance(v, float) else v

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.fixture(scope="session")
def as_rows():
    return rows
