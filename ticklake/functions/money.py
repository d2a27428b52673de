"""Prices, sizes and fees. Prices are whole cents of a contract that pays 100."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: fee rates of takers and makers, and those of the rounded variants in cents
TAKER_RATE, MAKER_SHARE = 0.07, 0.25
MAKER_CENT_RATE, TAKER_CENT_RATE = 0.0175, 0.0287


def dollars_to_cents(text: Column) -> Column:
    """Dollar text as cents, halves to even."""
    return F.rint(text.cast("double") * 100).cast("int")


def parse_size(text: Column) -> Column:
    """Fixed-point text as whole contracts, halves to even."""
    return F.rint(text.cast("double")).cast("bigint")


def loose_cents(value: Column) -> Column:
    """A price of up to 1.0 is in dollars, any other in cents."""
    v = value.cast("double")
    return F.when(v <= 1.0, F.rint(v * 100)).otherwise(F.rint(v)).cast("int")


def seconds_to_ns(seconds: Column) -> Column:
    return (seconds * F.lit(1e9)).cast("bigint")


def taker_fee(price: Column) -> Column:
    """Dollars per contract at a price in dollars."""
    return F.lit(TAKER_RATE) * price * (F.lit(1.0) - price)


def maker_fee(price: Column) -> Column:
    return taker_fee(price) * F.lit(MAKER_SHARE)


def maker_fee_cents(cents: Column) -> Column:
    return F.greatest(F.lit(1), (F.lit(MAKER_CENT_RATE) * cents * (100 - cents) / 100).cast("int"))


def taker_fee_cents(cents: Column) -> Column:
    return F.greatest(F.lit(1), (F.lit(TAKER_CENT_RATE) * cents * (100 - cents) / 100).cast("int"))


def entry_fees(first: Column, second: Column, maker_legs: int) -> Column:
    """Fees to enter two legs, the first ``maker_legs`` of them as maker."""
    legs = [maker_fee(p) if k < maker_legs else taker_fee(p) for k, p in enumerate((first, second))]
    return legs[0] + legs[1]


def imbalance(yes: Column, no: Column) -> Column:
    """(yes - no) / (yes + no + 1)."""
    return (yes - no) / (yes + no + 1)


def consumed(taker: Column, price: Column) -> tuple[Column, Column]:
    """Side and price of the resting order that a trade took: a YES taker takes NO at 100 less the price."""
    return F.when(taker == "yes", "no").otherwise("yes"), F.when(taker == "yes", 100 - price).otherwise(price)


def top_size(levels: Column, side: str) -> Column:
    """Size at a side's highest price in an array of (side, price, qty); null without levels."""
    own = F.transform(F.filter(levels, lambda x: x["side"] == side), lambda x: F.struct(x["price"].alias("price"), x["qty"].alias("qty")))
    return F.array_max(own)["qty"]


def edge(probability: Column, cents: Column, yes_is_home: Column) -> Column:
    """Model probability of YES less its price."""
    return F.when(yes_is_home, probability).otherwise(1 - probability) - cents / 100
