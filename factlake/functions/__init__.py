from factlake.functions.columns import (  # noqa: F401
    days_between,
    fiscal_year,
    nonzero,
    parse_decimal,
    parse_int,
    parse_timestamp,
    parse_yyyymmdd,
    safe_ratio,
    to_decimal,
)
