"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries`` and ``oracle_sql`` are
what the repository's entry point registers.
"""

from fieldlark.llm.queries import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
