"""Every registered query of the library against its SQL at the smallest scale."""

import pytest

from larchgraph.plans import catalogue
from tests import oracle

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, name):
    if name in catalogue.ORACLES:
        assert oracle.compare(spark, name, catalogue.QUERIES[name], catalogue.ORACLES[name], SF) == ""
    else:
        assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_no_oracle_is_empty():
    """A query that gives nothing proves nothing."""
    assert [k for k, sql in catalogue.ORACLES.items() if not oracle.expected(sql, SF).fetchall()] == []


def test_snapshots_differ_in_every_kind():
    rows = {(kind, change) for kind, _, change in oracle.expected(catalogue.ORACLES["fact_deltas"], "/root/testdata/sf0.01").select("kind, key, change").fetchall()}
    assert rows == {(k, c) for k in ("function", "cycle-function", "hotspot", "file", "script", "cycle-file", "unresolved") for c in ("added", "removed")}
    status = dict(oracle.expected(catalogue.ORACLES["policy_checks"], "/root/testdata/sf0.01").select("id, status").fetchall())
    assert sum(s == "fail" for s in status.values()) >= 5 and "pass" in status.values()


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())
