"""Every registered query of the reference's operators against its SQL."""

import pytest
from compare import same

from rankloom.plans import catalog

QUERIES, ORACLE = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        same(df, ORACLE[name], sf_dir)
    else:
        assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert [r["slot"] for r in sorted(rows)] == list(range(1, 11))
    assert set(entry.oracle_sql()) <= set(entry.queries())
