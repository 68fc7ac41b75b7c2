"""All registered queries: name to (spark, directory) -> DataFrame, and the SQL that must agree."""

from __future__ import annotations

from postern.plans import analysis, mail, metrics, problems, raw, textual

_MODULES = (problems, textual, analysis, mail, metrics, raw)

QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in m.SQL.items()}
FLAGSHIP = QUERIES["c09_campaigns"]
