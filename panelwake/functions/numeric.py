"""Bins, ratios, likelihood pieces and other arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit-count classes and numeric guards of the likelihood.
UNIT_CLASSES = [(2, 5), (6, 19), (20, 49), (50, None)]
UNIT_FALLBACK = 3.0
CLAMP_EPS = 1e-7
TRUNC_EPS = 1e-12


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def unit_class(units: Column | str) -> Column:
    u = _col(units)
    out = F.when(u.isNull(), "unmatched").when(u < 2, "<2")
    for lo, hi in UNIT_CLASSES:
        if hi is None:
            out = out.when(u >= lo, f"{lo}+")
        else:
            out = out.when((u >= lo) & (u <= hi), f"{lo}-{hi}")
    return out.otherwise("unmatched")


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL unless den > 0."""
    return F.when(den > 0, num.cast("double") / den)


def positive(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c > 0, c)


def building_age(season: Column, year_built: Column) -> Column:
    return season - positive(year_built)


def prewar(year_built: Column) -> Column:
    return F.when((year_built > 0) & (year_built < 1940), 1).otherwise(0)


def units_ladder(total: Column, residential: Column) -> tuple[Column, Column]:
    """Units with their source: 0 total, 1 residential, 2 constant."""
    value = (
        F.when(total >= 1, total.cast("double"))
        .when(residential >= 1, residential.cast("double"))
        .otherwise(F.lit(UNIT_FALLBACK))
    )
    source = F.when(total >= 1, 0).when(residential >= 1, 1).otherwise(2)
    return value, source


def cap_units(u: Column, k: Column, limit: Column | float) -> tuple[Column, Column]:
    cap = limit if isinstance(limit, Column) else F.lit(float(limit))
    u_c = F.least(u, cap)
    return u_c, F.least(k, u_c)


def clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(x, F.lit(hi)), F.lit(lo))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p) - F.log(1.0 - p)


def detection(p: Column, u: Column) -> Column:
    """Probability that at least one of u units reports."""
    return 1.0 - F.pow(1.0 - p, u)


def log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x > 0: Stirling's series at x + 8, walked back by the recurrence."""
    shift = 8
    z = x + float(shift)
    product = x
    for i in range(1, shift):
        product = product * (x + float(i))
    series = 0.0
    r = 1.0 / z
    r2 = r * r
    # Bernoulli-number coefficients of Stirling's series
    series = r * (
        1 / 12.0 - r2 * (1 / 360.0 - r2 * (1 / 1260.0 - r2 * (1 / 1680.0 - r2 * (1 / 1188.0))))
    )
    stirling = (z - 0.5) * F.log(z) - z + 0.5 * math.log(2 * math.pi) + series
    return stirling - F.log(product)


def log_choose(n: Column, k: Column) -> Column:
    return log_gamma(n + 1.0) - log_gamma(k + 1.0) - log_gamma(n - k + 1.0)


def percent_text(part: Column, whole: Column, digits: int = 1) -> Column:
    """'12.5%', a dash when there is nothing to divide by."""
    share = F.format_number(100.0 * part / whole, digits)
    return F.when(whole > 0, F.concat(F.regexp_replace(share, ",", ""), F.lit("%"))).otherwise("—")


def mixed_radix(index: Column, dims: list[tuple[str, list]]) -> dict[str, Column]:
    """Decode a configuration number; the last dimension varies fastest."""
    out: dict[str, Column] = {}
    place = 1
    for name, values in reversed(dims):
        digit = F.floor(index / F.lit(place)) % F.lit(len(values))
        out[name] = F.element_at(F.array(*[F.lit(v) for v in values]), (digit + 1).cast("int"))
        place *= len(values)
    return {name: out[name] for name, _ in dims}


def edge_status(value: Column, values: list) -> Column:
    """Whether a chosen value lies inside or on an edge of its list."""
    at = F.array_position(F.array(*[F.lit(v) for v in values]), value)
    return F.when(at == 1, "low-edge").when(at == len(values), "high-edge").otherwise("interior")
