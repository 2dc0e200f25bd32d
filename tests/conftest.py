import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)

from pagewright.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = local_session("tests", cpus=os.environ.get("TEST_CPUS", "4"), partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def duck():
    import glob

    import duckdb

    con = duckdb.connect()
    for f in glob.glob(SF + "/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def canonical(pdf):
    """Rows of a frame as sorted tuples of texts, columns by name."""
    import pandas as pd

    cols = sorted(pdf.columns)

    def one(v):
        if v is None or (isinstance(v, float) and v != v) or v is pd.NaT or v is pd.NA:
            return "null"
        if isinstance(v, float):
            return repr(round(v, 9) + 0.0)
        return str(v)

    return cols, sorted(tuple(one(v) for v in row) for row in pdf[cols].astype(object).itertuples(index=False))


def same(spark_df, duck_df):
    a_cols, a = canonical(spark_df.toPandas())
    b_cols, b = canonical(duck_df)
    assert a_cols == b_cols
    assert len(a) == len(b), (len(a), len(b))
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    assert not wrong, wrong[:3]
