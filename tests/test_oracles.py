"""Every query with SQL gives the rows the SQL gives."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from check_oracles import duck, rows_of  # noqa: E402

from workload import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    cur = con.execute(ORACLES[name])
    columns = [c[0] for c in cur.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, cur.fetchall())


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
