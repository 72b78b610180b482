"""All registered queries."""

from corpusmap.plans import changes, files, live, reports, scalars, sessions, stores  # noqa: F401
from corpusmap.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
