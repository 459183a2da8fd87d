"""Spark-native analytics for depth-sensor captures."""

from depthloom.plans.validate import INVALID, VALID, WARNED, Report, validate

__all__ = ["INVALID", "VALID", "WARNED", "Report", "validate"]
