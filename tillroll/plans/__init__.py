"""Registered reports and their oracle SQL."""

from tillroll.plans.oracle_sql import ORACLE
from tillroll.plans.reports import REPORTS, STATEMENTS, study_reports

__all__ = ["ORACLE", "REPORTS", "STATEMENTS", "study_reports"]
