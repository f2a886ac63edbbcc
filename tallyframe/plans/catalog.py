"""All queries of the library."""

from . import accounts, audits, building, checking, cleaning, comparing, further, panels, repairs, running, running_jobs, scoring, storing, studies, supervised  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
