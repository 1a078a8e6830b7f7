"""Run reports and the checked queries over the given tables."""

from mselect.plans import checks_features, checks_models, checks_reports, checks_tables  # noqa: F401
from mselect.plans.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
