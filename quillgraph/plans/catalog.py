"""The named queries and their SQL."""

from __future__ import annotations

from . import relational, texts

QUERIES = relational.QUERIES | texts.QUERIES
ORACLE_SQL = relational.ORACLE_SQL | texts.ORACLE_SQL
flagship = relational.flagship
