"""Sizes and prices by model name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Context sizes in tokens.
BUDGETS = {"gpt-4o": 128_000, "gpt-4": 128_000, "gpt-3.5-turbo": 16_385, "claude-sonnet": 200_000, "claude-opus": 200_000, "claude-haiku": 200_000}
DEFAULT_BUDGET = 128_000

# US dollars for a million input tokens.
PRICES = {
    "gpt-4o": 2.50, "gpt-4o-mini": 0.15, "gpt-4.1": 2.00, "gpt-4.1-mini": 0.40, "gpt-4.1-nano": 0.10,
    "claude-sonnet-4-6": 3.00, "claude-sonnet-4-5-20250514": 3.00, "claude-haiku-4-5": 0.80, "claude-haiku-4-5-20251001": 0.80, "claude-opus-4-6": 15.00,
}
DEFAULT_PRICE = 1.00


def _lookup(key: Column, values: dict, default: float) -> Column:
    told = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(told, key), F.lit(default))


def model_budget(model: str) -> int:
    return BUDGETS.get(model, DEFAULT_BUDGET)


def budget_of(model: Column) -> Column:
    return _lookup(model, BUDGETS, DEFAULT_BUDGET).cast("long")


def price_of(model: Column) -> Column:
    return _lookup(model, PRICES, DEFAULT_PRICE)
