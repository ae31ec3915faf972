"""All queries of the library, by name."""

from __future__ import annotations

from . import q_audits, q_lines, q_records, q_tables

MODULES: tuple = (q_lines, q_audits, q_tables, q_records)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
