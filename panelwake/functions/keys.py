"""Entity keys, coercions and lookups in small fixed tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_number(c: Column | str) -> Column:
    """Number or NULL."""
    return _col(c).try_cast("double")


def to_timestamp(c: Column | str) -> Column:
    """Zone-less timestamp or NULL."""
    return _col(c).try_cast("timestamp_ntz")


def normalize_key(c: Column | str, drop_nonpositive: bool = True) -> Column:
    """'2054800111.00000000' -> 2054800111; what is not a number becomes NULL."""
    n = to_number(c)
    if drop_nonpositive:
        n = F.when(n > 0, n)
    return F.rint(n).try_cast("long")


def composite_key(boro: Column | str, block: Column | str, lot: Column | str) -> Column:
    """borough, five-digit block and four-digit lot as one integer."""
    part = lambda c: to_number(c).try_cast("long").cast("string")
    text = F.concat(part(boro), F.lpad(part(block), 5, "0"), F.lpad(part(lot), 4, "0"))
    return text.try_cast("long")


def is_blank(c: Column | str) -> Column:
    c = _col(c)
    return c.isNull() | (F.trim(c) == "")


def first_letter(c: Column | str) -> Column:
    """First character after trimming, NULL for nothing."""
    return F.nullif(F.substring(F.trim(_col(c)), 1, 1), F.lit(""))


def leading_part(c: Column | str, unit: int) -> Column:
    """Leading digits of an integer key."""
    return F.floor(_col(c) / F.lit(unit)).cast("long")


def recode(c: Column | str, table: dict) -> Column:
    """Lookup in a small fixed table; values outside it become NULL."""
    c = _col(c)
    out = None
    for source, target in table.items():
        out = F.when(c == source, target) if out is None else out.when(c == source, target)
    return out


def coercion_losses(raw: Column, typed: Column) -> Column:
    """Aggregate: values lost by a cast."""
    return F.count_if(raw.isNotNull() & typed.isNull())
