"""All registered queries of the core, with their SQL."""

from __future__ import annotations

from tidelake.plans import daily, dashboards, merges, problem_oracles, problems, reference


def queries() -> dict:
    return problems.queries() | reference.queries() | merges.queries() | {"daily_pipeline": daily.daily_pipeline} | dashboards.queries()


def oracle_sql() -> dict[str, str]:
    return problem_oracles.ORACLES | reference.ORACLES | merges.ORACLES | {"daily_pipeline": daily.oracle()} | dashboards.oracle_sql()
