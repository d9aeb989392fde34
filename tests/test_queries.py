import pytest
from oracle import frames

from copyloom import queries
from copyloom.plans import checks, cohorts, estimates, more, samples, units  # noqa: F401


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    got, want = frames(spark, queries.queries()[name], queries.oracle_sql()[name], "sf0.001")
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_has_rows(spark, name):
    assert queries.queries()[name](spark, "/root/testdata/sf0.01").count()


def test_entry_imports():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
