"""All queries of the panel engine, and their SQL."""

from __future__ import annotations

from . import audits, learners, panel, scores, selection, studies

QUERIES = {**panel.QUERIES, **scores.QUERIES, **studies.QUERIES, **audits.QUERIES, **learners.QUERIES, **selection.QUERIES}
ORACLE_SQL = {**panel.ORACLE_SQL, **scores.ORACLE_SQL, **studies.ORACLE_SQL, **audits.ORACLE_SQL, **learners.ORACLE_SQL, **selection.ORACLE_SQL}
