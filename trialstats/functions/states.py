"""Predicates, labels and texts over outcome states, rates and errors."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from trialstats.schema import FAIL, INVALID, PASS

# An error text with any of these, in lower case, is worth another try.
RETRYABLE_MARKERS = (
    "rate_limit",
    "429",
    "503",
    "unavailable",
    "overloaded",
    "timed out",
    "timeout",
    "connection",
)

# Upper bounds of |delta| and the label below each; the last label has no bound.
EFFECT_SCALES: dict[str, tuple[tuple[float | None, str], ...]] = {
    "code": ((0.2, "Negligible"), (0.5, "Medium"), (None, "Large")),
    "paper": ((0.147, "Negligible"), (0.33, "Small"), (0.474, "Medium"), (None, "Large")),
}


def initially_failing(initial: str = "initial_state") -> Column:
    """True for rows in the population of the rate; never null."""
    return F.col(initial).eqNullSafe(FAIL)


def succeeded(final: str = "final_state") -> Column:
    """True only for ``pass``: INVALID and null are no success; never null."""
    return F.col(final).eqNullSafe(PASS)


def is_invalid(final: str = "final_state") -> Column:
    return F.col(final).eqNullSafe(INVALID)


def rate(part: Column, whole: Column) -> Column:
    """``part / whole * 100`` in DOUBLE and in that order; 0.0 where ``whole`` is zero or null."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0), F.lit(0.0))


def retryable(error: str) -> Column:
    """True where the error text has one of the retry markers; false for null."""
    return F.coalesce(F.lower(F.col(error)).rlike("|".join(RETRYABLE_MARKERS)), F.lit(False))


def outcome_state(first_reply: str, second_reply: str, error: str, verdict: str) -> Column:
    """INVALID where a reply is missing or an error was raised, else pass or fail by the verdict."""
    return (
        F.when(F.col(error).isNotNull() & (F.col(error) != ""), INVALID)
        .when(F.col(first_reply).isNull() | F.col(second_reply).isNull(), INVALID)
        .when(F.coalesce(F.col(verdict), F.lit(False)), PASS)
        .otherwise(FAIL)
    )


def effect_label(delta: str, scale: str | Sequence[tuple[float | None, str]] = "code") -> Column:
    """Size class of ``|delta|``, by a named scale or by (upper bound, label) pairs."""
    bounds = EFFECT_SCALES[scale] if isinstance(scale, str) else scale
    size = F.abs(F.col(delta))
    label: Column | None = None
    for upper, text in bounds[:-1]:
        label = F.when(size < upper, text) if label is None else label.when(size < upper, text)
    last = F.lit(bounds[-1][1])
    return last if label is None else label.when(size.isNotNull(), last)


def decision(p_value: str, mean_rate: str, alpha: float = 0.05, floor: float = 16.06) -> Column:
    """Reject the null hypothesis: small p and a mean rate above the floor."""
    return (F.col(p_value) < alpha) & (F.col(mean_rate) > floor)


def fixed(value: str, decimals: int = 2, suffix: str = "") -> Column:
    """Text with one to six fixed decimals, rounded as printf does: from the exact binary value, half to even.

    Java rounds the shortest decimal text instead, half up: 71.585 is a little below that in binary,
    and printf makes it 71.58, Java 71.59. Here the fraction is taken as an integer of 92 binary
    places, which hold every double that is near a tie.
    """
    c = F.col(value).cast("double")
    whole = F.floor(F.abs(c))
    high = (F.abs(c) - whole) * F.lit(float(2**52))
    low = (high - F.floor(high)) * F.lit(float(2**40))
    places = (
        F.floor(high).cast("decimal(20,0)") * F.lit(2**40).cast("decimal(13,0)") + F.floor(low).cast("decimal(20,0)")
    ).cast("decimal(28,0)")
    one, half = (F.lit(Decimal(2**n)).cast("decimal(28,0)") for n in (92, 91))
    scaled = places * F.lit(10**decimals).cast("decimal(7,0)")
    digits, left = F.call_function("div", scaled, one), scaled % one
    up = (left > half) | ((left == half) & (digits % 2 == 1))
    digits = digits + F.when(up, 1).otherwise(0)
    return F.concat(
        F.when(c < 0, "-").otherwise(""),
        (whole + F.call_function("div", digits, F.lit(10**decimals))).cast("string"),
        F.lit("."),
        F.lpad((digits % 10**decimals).cast("string"), decimals, "0"),
        F.lit(suffix),
    )


def percent(value: str, decimals: int = 2) -> Column:
    return fixed(value, decimals, "%")


def yes_no(flag: str) -> Column:
    return F.when(F.col(flag), "Yes").otherwise("No")


def clipped(value: Column, low: float, high: float) -> Column:
    """Value held inside [low, high]; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def any_success(states: str, k: int | None = None) -> Column:
    """Any ``pass`` in an array of final states, or in its first ``k`` entries."""
    array = F.col(states) if k is None else F.slice(F.col(states), 1, k)
    return F.exists(array, lambda s: s.eqNullSafe(F.lit(PASS)))
