"""All queries of the core and their SQL."""

from __future__ import annotations

from lodestock.plans import catalogue, common, constraints, extras, problems, profiling  # noqa: F401 - the modules register their queries

QUERIES = common.QUERIES | problems.QUERIES
ORACLES = common.ORACLES | problems.ORACLES
