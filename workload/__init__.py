"""Queries over the test tables, each with the SQL that must give the same rows."""

from workload import audits, checks, matching, offers, page_jobs, scalars, sources_health  # noqa: F401
from workload.base import ORACLES, QUERIES
from workload.offers import flagship

__all__ = ["ORACLES", "QUERIES", "flagship"]
