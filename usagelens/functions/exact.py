"""Exact arithmetic helpers.

Money is carried as integer nano-USD and ratios are rounded in integer space,
so a result does not depend on the order in which partitions were summed.
A column turns into a double only in the last step.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NANO_PER_E4 = 100_000          # nano-USD in 1e-4 USD
NANO_PER_CENT = 10_000_000     # nano-USD in 1e-2 USD


def _col(c) -> Column:
    if isinstance(c, Column):
        return c
    return F.col(c) if isinstance(c, str) else F.lit(c)


def wide(c) -> Column:
    """38-digit integer: room for products of sums at fleet scale."""
    return _col(c).cast("decimal(38,0)")


def idiv(n, d) -> Column:
    """Integer division, NULL for a zero divisor."""
    return F.call_function("div", wide(n), F.nullif(wide(d), F.lit(0)))


def round_div(n, d, *, signed: bool = False) -> Column:
    """n / d rounded half away from zero, as BIGINT; NULL for a zero divisor. d must not
    be negative, and n only where `signed`."""
    n, d = wide(n), wide(d)
    half = F.when(n < 0, -d).otherwise(d) if signed else d
    return F.call_function("div", n * 2 + half, F.nullif(d * 2, F.lit(0)))


def scaled(units, places: int) -> Column:
    """Integer count of 10**-places units as a double."""
    return _col(units).cast("double") / 10.0 ** places


def cost_e4(nano) -> Column:
    """Nano-USD rounded to 1e-4 USD, as BIGINT."""
    return F.call_function("div", _col(nano) + NANO_PER_E4 // 2, F.lit(NANO_PER_E4))


def usd4(nano) -> Column:
    return scaled(cost_e4(nano), 4)


def usd2(nano) -> Column:
    return scaled(round_div(nano, NANO_PER_CENT), 2)


def ratio(n, d, places: int, *, signed: bool = False) -> Column:
    """n / d rounded to `places`, 0 when d is not positive."""
    r = scaled(round_div(wide(n) * 10 ** places, d, signed=signed), places)
    return F.when(_col(d) > 0, r).otherwise(0.0)


# The same as SQL text, for expressions over plain column names: one call builds them.


def usd4_sql(nano: str) -> str:
    return f"CAST(({nano} + {NANO_PER_E4 // 2}) div {NANO_PER_E4} AS DOUBLE) / 1e4D"


def ratio_sql(n: str, d: str, places: int) -> str:
    wide_n, wide_d = f"CAST({n} AS DECIMAL(38,0))", f"CAST({d} AS DECIMAL(38,0))"
    rounded = f"({wide_n} * {2 * 10 ** places} + {wide_d}) div nullif({wide_d} * 2, 0)"
    return f"CASE WHEN {d} > 0 THEN CAST({rounded} AS DOUBLE) / 1e{places}D ELSE 0D END"


def per_hour_cents(nano, hours_e4) -> Column:
    """Cost over a window of hours_e4 ten-thousandths of an hour, in cents per hour."""
    return round_div(wide(nano) * 10_000, wide(hours_e4) * NANO_PER_CENT)


def percentile_x100(sorted_values: Column, q: int) -> Column:
    """Linear-interpolation percentile (q in percent) of a sorted integer array, times 100.

    NULL for an empty array. Meant for arrays bounded by calendar time (days or
    five-hour windows of one key); raw records go through `exact_percentiles`.
    """
    n = F.size(sorted_values)
    pos = F.lit(q) * (n - 1)
    lo = F.call_function("div", pos, F.lit(100)).cast("int")
    frac = pos % 100
    low = F.get(sorted_values, lo)
    high = F.get(sorted_values, F.least(lo + 1, n - 1))
    return F.when(n > 0, low * (100 - frac) + high * frac).cast("bigint")


def sorted_list(c, when: Column | None = None) -> Column:
    """Aggregate: ascending array of the non-null values (optionally filtered)."""
    return F.sort_array(F.collect_list(_col(c) if when is None else F.when(when, _col(c))))
