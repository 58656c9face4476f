"""Every query over the smallest tables against its SQL, and those without SQL for stable, non-empty results."""

import pytest

from ledgerline import plans
from tests import plain
from tests.oracle import against_sql


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_against_sql(spark, sf, name):
    against_sql(plans.QUERIES[name](spark, sf), plans.ORACLE[name], sf)


def test_all_have_truth():
    """What SQL cannot express has a plain version in ``tests.plain``."""
    assert set(plans.QUERIES) == set(plans.ORACLE) | set(plain.TRUTH)


@pytest.mark.parametrize("name", sorted(plain.TRUTH))
def test_against_plain(spark, sf, name):
    """Queries without SQL against a plain Python version over the same rows."""
    df = plans.QUERIES[name](spark, sf)
    got = sorted([tuple(r) for r in df.collect()], key=str)
    assert got == sorted(plain.TRUTH[name](spark, sf), key=str) and got


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
