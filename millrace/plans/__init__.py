"""Registered queries over the test tables and their SQL."""

from millrace.plans.queries import QUERIES
from millrace.plans.sql import ORACLE

__all__ = ["ORACLE", "QUERIES"]
