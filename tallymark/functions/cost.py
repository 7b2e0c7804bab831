"""Costs of predictions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds of a unit; imputed USD an hour by size of the model.
UNITS = {"s": 1, "sec": 1, "second": 1, "seconds": 1, "m": 60, "min": 60, "minute": 60, "minutes": 60, "h": 3600, "hr": 3600, "hour": 3600, "hours": 3600, "d": 86400, "day": 86400, "days": 86400}
HOURLY_SMALL, HOURLY_MEDIUM, HOURLY_LARGE = 1.006, 1.212, 16.288


def time_unit_seconds(text: str) -> float:
    """Seconds of ``[n]unit``, such as '30 min' or 'hour'."""
    match = re.fullmatch(r"\s*(\d+(?:\.\d+)?)?\s*([A-Za-z]+)\s*", text)
    if not match or match[2].lower() not in UNITS:
        raise ValueError(f"not a time unit: {text!r}")
    return float(match[1] or 1) * UNITS[match[2].lower()]


def imputed_hourly(model: Column) -> Column:
    """Open models of the llama family by billions of parameters; the middle rate for others."""
    low = F.lower(model)
    size = F.regexp_extract(low, r"(\d+(?:\.\d+)?)\s*b\b", 1).try_cast("double")
    llama = F.when(size <= 8, HOURLY_SMALL).when(size <= 30, HOURLY_MEDIUM).otherwise(HOURLY_LARGE)
    return F.when(low.contains("llama"), llama).otherwise(F.lit(HOURLY_MEDIUM))


def imputed_cost(model: Column, seconds: Column) -> Column:
    return imputed_hourly(model) * seconds / 3600


def effective_cost(cost: Column, model: Column, seconds: Column, rate: Column | None = None, unit_seconds: float = 3600.0) -> Column:
    """A given rate by time, else the provider's cost, else, where that is exactly 0, imputed."""
    own = F.when(cost == 0, imputed_cost(model, seconds)).otherwise(cost)
    return own if rate is None else F.coalesce(rate * seconds / F.lit(unit_seconds), own)


def token_cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    return tokens_in * rate_in + tokens_out * rate_out
