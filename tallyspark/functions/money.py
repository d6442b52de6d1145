"""Token estimates and decimal prices."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, functions as F

# --- fixed values: spend limits ------------------------------------------------
DEFAULT_CAP_USD = Decimal("0.80")
MAX_CAP_USD = Decimal("1.00")
# ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Pricing:
    model: str = "stub-model"
    input_usd_per_million: Decimal = Decimal("0.30")
    output_usd_per_million: Decimal = Decimal("2.50")


def token_estimate(text: Column) -> Column:
    """Half the UTF-8 bytes, rounded up, at least one."""
    return tokens_from_bytes(F.octet_length(text))


def tokens_from_bytes(n_bytes: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((n_bytes + 1) / 2)).cast("long")


def cost_usd(input_tokens: Column, output_tokens: Column, pricing: Pricing) -> Column:
    """Decimal price rounded up to a millionth of a dollar; negative counts give null."""
    def scaled(tokens: Column, price: Decimal) -> Column:
        return tokens.cast("decimal(20,0)") * F.lit(price).cast("decimal(8,2)")

    total = scaled(input_tokens, pricing.input_usd_per_million) + scaled(output_tokens, pricing.output_usd_per_million)
    micros = F.ceil(total)  # usd per million tokens x tokens = millionths of a dollar
    usd = (micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)")
    return F.when((input_tokens >= 0) & (output_tokens >= 0), usd)


def checked_cap(cap: Decimal) -> Decimal:
    if cap <= 0 or cap > MAX_CAP_USD:
        raise ValueError(f"cap must be greater than zero and no more than USD {MAX_CAP_USD}")
    return cap
