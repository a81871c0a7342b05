"""Every registered query agrees with its SQL on the smallest tables; those without SQL run."""

import oracle
import pytest

from heronry.queries import ORACLE, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, name):
    if name in ORACLE:
        assert oracle.difference(spark, small, QUERIES[name], ORACLE[name]) == ""
    else:
        df = QUERIES[name](spark, small)
        assert df.columns and df.count() >= 0


def test_entry(spark, small):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
