"""Evidence floors: how strong a number is, and when it may be shown at all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


# --- fixed values: thresholds that results must agree on -------------------
HIGH_OBSERVATIONS, HIGH_DAYS, HIGH_COMPLETENESS = 100, 20, 0.95
SMALL_GROUP_FLOOR = 20
RESULT_LIMIT_MAX = 20
GRADE_ELIGIBLE_TOTAL, GRADE_ELIGIBLE_EACH, GRADE_DIRECTIONAL_TOTAL = 20, 5, 10
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class AnalysisPolicy:
    """Reliability and display thresholds; ``version`` travels with results."""

    min_comparison_orders: int = 50
    min_comparison_days: int = 14
    min_completeness: float = 0.90
    long_delivery_minutes: float = 90.0
    max_results: int = 8
    version: str = "policy-v1"


def strength(observations: Column, days: Column, completeness: Column, policy: AnalysisPolicy) -> Column:
    high = (observations >= HIGH_OBSERVATIONS) & (days >= HIGH_DAYS) & (completeness >= HIGH_COMPLETENESS)
    return (
        F.when(high, F.lit("high"))
        .when(meets_floor(observations, days, completeness, policy), F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def meets_floor(observations: Column, days: Column, completeness: Column, policy: AnalysisPolicy) -> Column:
    return (
        (observations >= policy.min_comparison_orders)
        & (days >= policy.min_comparison_days)
        & (completeness >= policy.min_completeness)
    )


def weakest(first: Column, second: Column) -> Column:
    """The weaker of two strengths."""
    level = lambda c: F.when(c == "high", 2).when(c == "medium", 1).otherwise(0)
    least = F.least(level(first), level(second))
    return F.when(least == 2, F.lit("high")).when(least == 1, F.lit("medium")).otherwise(F.lit("low"))


def trend_grade(early: Column, recent: Column) -> Column:
    total = early + recent
    return (
        F.when((total >= GRADE_ELIGIBLE_TOTAL) & (F.least(early, recent) >= GRADE_ELIGIBLE_EACH), "eligible")
        .when(total >= GRADE_DIRECTIONAL_TOTAL, "directional")
        .otherwise("insufficient")
    )
