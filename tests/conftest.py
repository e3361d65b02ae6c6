import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from curaspark.session import session

    more = {
        "spark.sql.shuffle.partitions": "4",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
    }
    s = session("tests", "local[4]", **more)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def cell(v):
    import pandas as pd

    if hasattr(v, "__len__") and not isinstance(v, str):
        return repr([cell(x) for x in v])
    if pd.isna(v):
        return "null"
    if isinstance(v, (bool,)) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf":
        return repr(round(float(v), 6))
    return str(v)


def same_rows(a, b) -> bool:
    """Equal columns and, in any order, equal rows."""
    assert sorted(a.columns) == sorted(b.columns), (sorted(a.columns), sorted(b.columns))
    c = sorted(a.columns)
    rows = lambda x: sorted(tuple(cell(v) for v in r) for r in x[c].astype(object).itertuples(index=False))
    return rows(a) == rows(b)
