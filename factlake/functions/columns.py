"""Column-level helpers: all built-in expressions, so they stay inside
whole-stage codegen (no Python UDFs)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# Dates a nanosecond pandas timestamp can hold; the original loader turned
# anything outside into NULL, so the range guard must be written explicitly.
MIN_DATE = _dt.date(1677, 9, 22)
MAX_DATE = _dt.date(2262, 4, 11)


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fiscal_year(date_col: ColumnOrName) -> Column:
    """EXTRACT(YEAR FROM d)::int."""
    return F.year(_c(date_col))


def days_between(end: ColumnOrName, start: ColumnOrName) -> Column:
    """date - date as integer days (Spark's ``-`` gives an interval)."""
    return F.datediff(_c(end), _c(start))


def nonzero(c: ColumnOrName) -> Column:
    """NULLIF(c, 0)."""
    c = _c(c)
    return F.when(c != 0, c)


def safe_ratio(num: ColumnOrName, den: ColumnOrName) -> Column:
    """num / NULLIF(den, 0) computed in double (ANSI ``/ 0`` would raise, and
    decimal division keeps only 10 fractional digits)."""
    return _c(num).cast("double") / nonzero(_c(den).cast("double"))


def to_decimal(c: ColumnOrName, precision: int, scale: int) -> Column:
    """``::numeric(p,s)``: half-away-from-zero rounding cast."""
    return _c(c).cast(f"decimal({precision},{scale})")


def parse_yyyymmdd(c: ColumnOrName, guard_range: bool = True) -> Column:
    """``YYYYMMDD`` text -> date; malformed text or out-of-range -> NULL
    (7-digit text such as ``2024011`` is rejected)."""
    c = F.trim(_c(c))
    d = F.when((F.length(c) == 8) & c.try_cast("int").isNotNull(), F.try_to_date(c, "yyyyMMdd"))
    if guard_range:
        d = F.when(d.between(F.lit(MIN_DATE), F.lit(MAX_DATE)), d)
    return d


def parse_timestamp(c: ColumnOrName) -> Column:
    """``YYYY-MM-DD HH:MM:SS[.S]`` text -> timestamp without zone, bad -> NULL."""
    ts = F.try_to_timestamp(F.trim(_c(c)))
    return F.when(ts.isNotNull(), ts.cast("timestamp_ntz"))


def parse_int(c: ColumnOrName, type_name: str = "bigint") -> Column:
    """Text -> integer type, non-numeric or out-of-range -> NULL.

    Plain integer text is parsed directly; only text that is not (e.g. "4.0")
    takes the decimal route, where a whole number with a zero fraction is
    accepted the way a float parse followed by an integer cast accepts it.
    """
    c = F.trim(_c(c))
    as_dec = c.try_cast("decimal(38,10)")
    whole = F.when(as_dec == F.floor(as_dec), as_dec).try_cast(type_name)
    return F.coalesce(c.try_cast(type_name), whole)


def parse_decimal(c: ColumnOrName, precision: int = 28, scale: int = 4) -> Column:
    """Text -> decimal(p,s): exact, half-up rounding; plain or scientific
    notation ("2.50E7"); malformed or too large -> NULL."""
    return F.trim(_c(c)).try_cast(f"decimal({precision},{scale})")
