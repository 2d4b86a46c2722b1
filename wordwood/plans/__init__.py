"""The registered queries and, for most of them, the same question in SQL."""

from wordwood.plans.oracle import ORACLE_SQL
from wordwood.plans.queries import QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
