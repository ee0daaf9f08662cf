import pytest

import fastbreak.feature_queries
import fastbreak.model_queries
import fastbreak.more_queries  # noqa: F401
from fastbreak import queries
from tests.helpers import SF, oracle, rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.SQL:
        want = oracle().execute(queries.SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
