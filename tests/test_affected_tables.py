"""What the walk from many changed roots writes."""

from pathlib import Path

import pytest

from graphloom import queries
from graphloom.operators import traverse
from graphloom.plans.graph import CodeGraph

SF = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
def test_many_roots_need_no_second_table_of_edges(spark, monkeypatch):
    def written(_):
        raise AssertionError("edges are written beside the edges by file")

    monkeypatch.setattr(traverse, "FEW", 0)
    want = queries.queries()["affected_files"](spark, str(SF)).collect()
    monkeypatch.setattr(CodeGraph, "edges", property(written))
    assert queries.queries()["affected_files"](spark, str(SF)).collect() == want
