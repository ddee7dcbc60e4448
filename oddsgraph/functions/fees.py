"""Cost assumptions: fee schedule, fee formula and the cost register."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: published taker schedule and venue limits ------------------
TAKER_FEE_RATES = {
    "crypto": 0.07,
    "sports": 0.05,
    "finance": 0.04,
    "politics": 0.04,
    "economics": 0.05,
    "culture": 0.05,
    "weather": 0.05,
    "mentions": 0.04,
    "tech": 0.04,
    "geopolitics": 0.0,
    "other": 0.05,
}
DEFAULT_TAKER_FEE_RATE = 0.07
MIN_FEE = 0.00001
FALLBACK_MIN_ORDER_SIZE = 5.0
FALLBACK_TICK_SIZE = 0.01
MAX_BOOK_AGE_MS = 5_000
# (name, value, unit, source, enforced)
COST_REGISTER = [
    ("Taker fee rate (applied)", "0.07", "fraction", "highest published band", True),
    ("Maker fee", "0", "USDC", "baskets are modelled as all-taker", True),
    ("Gas per settlement", "0", "USDC", "the operator settles matched orders", True),
    ("Deposit / withdrawal", "0", "USDC", "no venue fee", False),
    ("Minimum order size (fallback)", "5", "shares", "used when no book is in hand", True),
    ("Tick size (fallback)", "0.01", "USDC", "the coarser observed tick", False),
    ("Maximum book age", "5000", "ms", "judgement", False),
    ("Capital cost of holding to resolution", "not modelled", "—", "no source", False),
]
# ------------------------------------------------------------------------------


def taker_fee(shares: Column, price: Column, rate: Column | float = DEFAULT_TAKER_FEE_RATE) -> Column:
    """shares · rate · p · (1 − p), zero below the venue's rounding limit. Per level."""
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    fee = shares * rate * price * (1 - price)
    return F.when((shares > 0) & (fee >= MIN_FEE), fee).otherwise(0.0)


def unit_cost(price: Column, rate: Column | float = DEFAULT_TAKER_FEE_RATE) -> Column:
    """Price of one share with its fee."""
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    return price + rate * price * (1 - price)


def fee_rate(category: Column, base_fee_bps: Column | None = None) -> Column:
    """Zero where the venue says fee-free, else the schedule, else the conservative rate.

    The schedule is eleven constants, so it is an expression and needs no join.
    """
    schedule = F.create_map(*[F.lit(x) for kv in TAKER_FEE_RATES.items() for x in kv])
    rate = F.coalesce(F.try_element_at(schedule, F.lower(category)), F.lit(DEFAULT_TAKER_FEE_RATE))
    if base_fee_bps is None:
        return rate
    return F.when(base_fee_bps == 0, 0.0).otherwise(rate)


def cost_register(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        COST_REGISTER, "name string, value string, unit string, source string, enforced boolean"
    )
