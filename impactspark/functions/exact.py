"""Sums and means of doubles that do not depend on the order of adding.

A double is cut into a whole number and three limbs of 24 bits behind the
binary point. Limbs are added as longs, which is exact in any order and on any
number of tasks, and become one double at the end. A digit below 2^-72 is cut
off per value. Totals of limbs can be added again, so partial results merge.
Whole parts are added as longs too: beyond 2^63 Spark raises, it does not wrap.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 24
MASK = (1 << BITS) - 1
LARGEST = 2.0**62  # larger values, infinities and NaN are added as doubles
LIMBS = ("whole", "high", "middle", "low", "odd")


def limbs(value: Column) -> dict[str, Column]:
    """The parts of one value; all NULL for NULL."""
    value = value.cast("double")
    usual = F.abs(value) < LARGEST
    x = F.when(usual, value)
    whole = F.floor(x)
    rest = x - whole.cast("double")
    high, deep = F.floor(rest * 2.0**BITS), rest * 2.0 ** (2 * BITS)
    return {
        "whole": whole,
        "high": high,
        "middle": F.floor(deep) - high * (1 << BITS),
        "low": F.floor((deep - F.floor(deep).cast("double")) * 2.0**BITS),
        "odd": F.when(~usual, value),
    }


def partial_sums(value: Column | str, name: str) -> list[Column]:
    """Aggregates `<name>_whole` ... of a group, to be merged by `merged_sum`."""
    value = F.col(value) if isinstance(value, str) else value
    return [F.sum(part).alias(f"{name}_{limb}") for limb, part in limbs(value).items()]


def from_limbs(totals: Sequence[Column]) -> Column:
    """One double; NULL when nothing was added."""
    whole, high, middle, low, odd = totals
    middle = middle + F.shiftright(low, BITS)
    high = high + F.shiftright(middle, BITS)
    whole = whole + F.shiftright(high, BITS)
    mask = F.lit(MASK).cast("long")
    behind = (high.bitwiseAND(mask) * (1 << BITS) + middle.bitwiseAND(mask)).cast("double") * 2.0 ** (-2 * BITS)
    total = whole.cast("double") + (behind + low.bitwiseAND(mask).cast("double") * 2.0 ** (-3 * BITS))
    return F.when(odd.isNull(), total).otherwise(odd + F.coalesce(total, F.lit(0.0)))


def merged_sum(name: str) -> Column:
    """The sum over rows of `partial_sums`."""
    return from_limbs([F.sum(f"{name}_{limb}") for limb in LIMBS])


def exact_sum(value: Column | str) -> Column:
    """Aggregate: the sum, NULL over no value."""
    value = F.col(value) if isinstance(value, str) else value
    return from_limbs([F.sum(part) for part in limbs(value).values()])


def exact_mean(value: Column | str) -> Column:
    """Aggregate: the mean, NULL over no value."""
    return F.try_divide(exact_sum(value), F.count(value))


def exact_sum_sql(value: str, where: str = "", over: str = "") -> str:
    """The same in DuckDB, for finite values within `LARGEST`."""
    tail = f"{f' FILTER ({where})' if where else ''}{f' OVER ({over})' if over else ''}"
    total = lambda e: f"CAST(sum({e}){tail} AS BIGINT)"
    whole, rest = f"CAST(floor({value}) AS BIGINT)", f"({value} - floor({value}))"
    high, deep = f"CAST(floor({rest} * {float(1 << BITS)}) AS BIGINT)", f"({rest} * {float(1 << 2 * BITS)})"
    middle = f"(CAST(floor({deep}) AS BIGINT) - {high} * {1 << BITS})"
    low = f"CAST(floor(({deep} - floor({deep})) * {float(1 << BITS)}) AS BIGINT)"
    w, h, m, lo = map(total, (whole, high, middle, low))
    m = f"({m} + ({lo} >> {BITS}))"
    h = f"({h} + ({m} >> {BITS}))"
    w = f"({w} + ({h} >> {BITS}))"
    behind = f"CAST(({h} & {MASK}) * {1 << BITS} + ({m} & {MASK}) AS DOUBLE) * {2.0 ** (-2 * BITS)!r}"
    return f"(CAST({w} AS DOUBLE) + ({behind} + CAST({lo} & {MASK} AS DOUBLE) * {2.0 ** (-3 * BITS)!r}))"


def exact_mean_sql(value: str, where: str = "", over: str = "") -> str:
    tail = f"{f' FILTER ({where})' if where else ''}{f' OVER ({over})' if over else ''}"
    return f"({exact_sum_sql(value, where, over)} / count({value}){tail})"
