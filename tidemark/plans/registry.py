"""All queries of the core and their SQL."""

from __future__ import annotations

from tidemark.plans import data_problems, data_problems_sql, landing, ledgers, modelled, more, relational, streams, views, weighted, windows  # noqa: F401

QUERIES = {**data_problems.QUERIES, **views.QUERIES}
SQL = {**data_problems_sql.SQL, **views.SQL}
