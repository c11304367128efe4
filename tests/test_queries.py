"""Each registered query of the library against its SQL, or for a result where SQL cannot express it."""

import pytest

from fieldlark.plans import oracle_sql, queries
from tests.oracle import difference


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_same_as_sql(spark, sf_dir, name):
    assert difference(spark, sf_dir, queries()[name], oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_gives_rows(spark, sf_dir, name):
    assert queries()[name](spark, sf_dir).count() > 0
