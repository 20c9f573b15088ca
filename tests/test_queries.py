"""Every query that has SQL gives its rows; the others run."""

import pytest
from compare import same_rows

import __spark_entry__ as entry_points
from allometra.plans import queries as q


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_same_rows_as_sql(spark, sf_dir, name):
    same_rows(spark, sf_dir, q.QUERIES[name], q.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLES)))
def test_has_rows(spark, sf_dir, name):
    assert not q.QUERIES[name](spark, sf_dir).isEmpty()


def test_entry_points(spark):
    assert entry_points.entry(spark).columns == ["vertex_id", "distance"]
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
