"""Unit-economics parameters of the marketplace model."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal


@dataclass(frozen=True)
class ReviewCost:
    """Cost of a bad review: ``low_base / score`` for 1 and 2 stars, ``mid``
    for 3 stars, nothing above."""

    low_base: float
    mid: float


@dataclass(frozen=True)
class Rates:
    # Fixed values of the model: 10 % commission on item prices, 80 per
    # active month of subscription, review costs 100/50/40 per seller review
    # and 75/37.5/30 per product review, 500 000 of IT cost shared by sellers
    # in proportion to the square root of their order count.
    commission: Decimal = Decimal("0.10")
    subscription_per_month: float = 80.0
    seller_review: ReviewCost = field(default_factory=lambda: ReviewCost(100.0, 40.0))
    product_review: ReviewCost = field(default_factory=lambda: ReviewCost(75.0, 30.0))
    it_total: float = 500_000.0


DEFAULT_RATES = Rates()
