import pytest

import __spark_entry__ as E
from conftest import SF001
from quarry.plans import catalog


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["item_id", "prompt", "contexts", "sources", "n_contexts"]
    for r in rows:
        assert r.prompt.startswith("<文本片段>:\n\n")
        assert r.prompt.endswith("\n<回答>: ")
        assert 0 <= r.n_contexts <= 3


def test_registry_consistent():
    qs, sql = E.queries(), E.oracle_sql()
    assert len(qs) >= 90
    assert set(sql) <= set(qs)
    assert len(set(qs)) == len(qs)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_every_query_runs_small(spark, name):
    """Each registered query runs on the smallest tables and has named,
    unique columns."""
    df = catalog.queries()[name](spark, SF001)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()
