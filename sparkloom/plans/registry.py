"""All registered queries of the feature and analytics operators, and their SQL."""

from sparkloom.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
