"""The registered questions on affected files where many roots have changed, against their SQL."""

from pathlib import Path

import duckdb
import pytest

from graphloom import queries
from graphloom.operators import traverse

SF = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
@pytest.mark.parametrize("name", ["affected_tests", "render_affected"])
def test_no_walk_from_each_root(spark, monkeypatch, name):
    def walked(*_):
        raise AssertionError("walks from each root by itself")

    monkeypatch.setattr(traverse, "impacted", walked)
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    found = queries.queries()[name](spark, str(SF)).collect()
    assert sorted(tuple(r) for r in found) == sorted(con.execute(queries.oracle_sql()[name]).fetchall())
