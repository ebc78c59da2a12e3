"""All registered queries of the graph library."""

from __future__ import annotations

from tessera.plans import queries as first
from tessera.plans import checks, upkeep  # noqa: F401  (register their queries)

queries, oracle_sql = first.queries, first.oracle_sql
