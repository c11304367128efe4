"""Registered queries over the test tables."""

from fieldlark.plans import evaluation, features, files, models, passages, records, spatial, state, texts  # noqa: F401  they register their queries
from fieldlark.plans.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
