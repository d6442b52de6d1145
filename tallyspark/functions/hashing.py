"""Stable hashes: deterministic shuffles, splits and fingerprints."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

# --- fixed values: evaluation split -------------------------------------------
EVALUATION_SEED = 20260806
FORCED_CALIBRATION = (150,)
FORCED_HELDOUT = (94, 102, 151, 152, 555)
CALIBRATION_PERCENT = 20
# --------------------------------------------------------------------------------


def stable_key(*parts: Column) -> Column:
    """SHA-256 over the parts joined by ':'; an order that ignores arrival order."""
    return F.sha2(F.concat_ws(":", *[p.cast("string") for p in parts]), 256)


def hash_percent(*parts: Column) -> Column:
    """0..99 from the first eight hex digits of the stable key."""
    head = F.conv(F.substring(stable_key(*parts), 1, 8), 16, 10).cast("long")
    return (head % 100).cast("int")


def conversation_split(conversation: Column, seed: int = EVALUATION_SEED) -> Column:
    """calibration or heldout; all turns of a conversation fall on the same side."""
    return (
        F.when(conversation.isin(*FORCED_CALIBRATION), "calibration")
        .when(conversation.isin(*FORCED_HELDOUT), "heldout")
        .when(hash_percent(F.lit(seed), conversation) < CALIBRATION_PERCENT, "calibration")
        .otherwise("heldout")
    )


def canonical_json(variant: Column) -> Column:
    """Compact JSON with sorted keys; equal payloads give equal text."""
    return F.to_json(variant)


def fingerprint(fields: Mapping[str, Column]) -> Column:
    """One hash over named values in name order."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)])), 256)
