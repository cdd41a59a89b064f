"""Scalar column helpers (all built-in Spark expressions, whole-stage codegen friendly).

Each helper maps one scalar function the reference's SQL/R uses to the Spark
expression with the same semantics, including NULL behaviour.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def f_upper(c) -> Column:
    return F.upper(_c(c))


def f_lower(c) -> Column:
    return F.lower(_c(c))


def f_substr(c, pos: int = 1, length: int = 1) -> Column:
    """1-based ``substr(c, pos, length)``."""
    return F.substring(_c(c), pos, length)


def f_split_part(c, sep: str = " ", n: int = 1) -> Column:
    """``split_part``: n-th field; '' when absent, NULL on NULL."""
    return F.split_part(_c(c), F.lit(sep), F.lit(n))


def f_length(c) -> Column:
    """Characters in a string, as bigint."""
    return F.length(_c(c)).cast("bigint")


def f_token_count(c) -> Column:
    """``array_length(regexp_split_to_array(t, '\\s'), 1)``.

    Splitting on every single whitespace character keeps empty tokens between
    consecutive blanks: 'a  b' -> 3, '' -> 1, NULL -> NULL.
    """
    return F.size(F.split(_c(c), r"\s")).cast("bigint")


def f_lpad(c, n: int = 2, pad: str = "0") -> Column:
    return F.lpad(_c(c).cast("string"), n, pad)


# fixed format strings: to_char pattern -> Spark datetime pattern
DATE_FORMATS = {
    "DD/MM/YYYY": "dd/MM/yyyy",
    "YYYY-MM": "yyyy-MM",
    "YYYY": "yyyy",
    "MM": "MM",
}


def f_date_format(c, fmt: str = "DD/MM/YYYY") -> Column:
    """``to_char(date, fmt)`` for the formats the reference uses."""
    return F.date_format(_c(c), DATE_FORMATS.get(fmt, fmt))


def f_date_diff(later, earlier) -> Column:
    """date - date as integer days (NULL if either side is NULL)."""
    return F.datediff(_c(later), _c(earlier)).cast("bigint")


def f_extract_day(ts_end, ts_start) -> Column:
    """``EXTRACT(DAY FROM ts_end - ts_start)``: whole days of the interval, toward zero."""
    return F.extract(F.lit("DAY"), _c(ts_end) - _c(ts_start)).cast("bigint")


def like_any(c, patterns: Iterable[str], case_insensitive: bool = True) -> Column:
    """``upper(c) LIKE upper(p1) OR upper(c) LIKE upper(p2) ...``; NULL stays NULL."""
    col = F.upper(_c(c)) if case_insensitive else _c(c)
    out = None
    for p in patterns:
        term = col.like(p.upper() if case_insensitive else p)
        out = term if out is None else (out | term)
    return out if out is not None else F.lit(False)


def f_case(*branches: tuple[Column, Column], default: Column) -> Column:
    """``CASE WHEN c1 THEN v1 WHEN c2 THEN v2 ... ELSE default END``."""
    out = F
    for cond, value in branches:
        out = out.when(cond, value)
    return out.otherwise(default)


def f_case_label(c, patterns: Iterable[str], yes: str = "Passed", no: str = "REFERRED") -> Column:
    """CASE WHEN upper(c) LIKE any pattern THEN yes ELSE no END (NULL -> no)."""
    return F.when(like_any(c, patterns), F.lit(yes)).otherwise(F.lit(no))


def f_recode(c, match: str, yes: str, no: str) -> Column:
    """Two-way recode: ``ifelse(x == match, yes, no)``; NULL goes to ``no``."""
    return F.when(_c(c) == F.lit(match), F.lit(yes)).otherwise(F.lit(no))


def f_party_initial(c) -> Column:
    """Republican -> 'R', anything else -> 'D' (the dashboard's recode)."""
    return f_recode(c, "Republican", "R", "D")


def f_concat(*parts) -> Column:
    """``paste(..., sep='')``: literals and columns concatenated."""
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def f_contains_ci(c, needle: str) -> Column:
    """``upper(c) LIKE '%NEEDLE%'`` without LIKE escaping pitfalls."""
    return F.upper(_c(c)).contains(needle.upper())


def f_from_json(c, schema: str) -> Column:
    """Parse a JSON text column with a declared schema (no inference)."""
    return F.from_json(_c(c), schema)


def f_micros(c, dtype: str) -> Column:
    """Microseconds since 1970 of a timestamp column; wall-clock (NTZ) values never pass
    through the session time zone, so their order survives clock changes."""
    c = _c(c)
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), c) if dtype == "timestamp_ntz" else F.unix_micros(c)
