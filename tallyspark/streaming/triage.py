"""Rule gate over arriving turns: stateless, so the same plan serves batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.rules import DEFAULT_RULES, RuleSet
from ..operators.conversations import customer_messages
from ..operators.triage import rule_results, with_gate


def gate_stream(turns: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Decided messages of a stream of turns."""
    return rule_results(with_gate(customer_messages(turns), rules))


def undecided_stream(turns: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Messages the rules leave to the scorer."""
    return with_gate(customer_messages(turns), rules).where(F.col("gate").isNull()).drop("gate")
