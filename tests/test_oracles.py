"""Every query of the listing side gives its oracle's rows."""

import compare
import pytest

from rentflow.plans import QUERY_SETS

QUERIES = {n: f for plans in QUERY_SETS for n, f in plans.QUERIES.items()}
ORACLE = {n: s for plans in QUERY_SETS for n, s in plans.ORACLE.items()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, sf_dir, name):
    names, got = compare.spark_rows(QUERIES[name](spark, sf_dir))
    wanted_names, wanted = compare.oracle(ORACLE[name], sf_dir)
    assert names == wanted_names
    assert got == wanted


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
