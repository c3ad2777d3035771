"""Scalar cleaning expressions (P02, P04, P07-P10, P12, P13, P18, rounding rules)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voltaic.constants import NAME_ACCENT_FOLD, WHITE_SPACE

__all__ = [
    "as_col", "safe_double", "parse_utc", "clean_text", "wind_speed", "kelvin_to_celsius",
    "parse_mw", "canonical_region_code", "kw_to_mw", "js_round", "nan_to_null",
    "end_of_day_bound", "normalize_name", "json_safe", "strip_ws",
]


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Both ends without any Unicode white space (``trim`` takes blanks only)."""
    return F.btrim(as_col(c), F.lit(WHITE_SPACE))


def nan_to_null(c) -> Column:
    """NaN -> NULL (Spark orders NaN above every number and sums propagate it)."""
    return F.nanvl(as_col(c), F.lit(None).cast("double"))


def safe_double(c) -> Column:
    """Value -> text -> trimmed -> double; unparsable text becomes NULL."""
    return nan_to_null(_try_double(strip_ws(as_col(c).cast("string"))))


def parse_utc(c) -> Column:
    """ISO-8601 text (offset honoured) -> UTC timestamp; bad text -> NULL."""
    return as_col(c).cast("string").try_cast("timestamp")


# Python's ``\s`` is Unicode-aware; Java needs (?U) to match e.g. a no-break space.
def clean_text(c) -> Column:
    """Collapse runs of whitespace to one blank and trim."""
    return F.trim(F.regexp_replace(as_col(c), r"(?U)\s+", " "))


def wind_speed(u, v) -> Column:
    """sqrt(u^2 + v^2)."""
    return F.hypot(as_col(u), as_col(v))


def kelvin_to_celsius(t) -> Column:
    """round(t - 273.15, 2) with half-even rounding."""
    return F.bround(as_col(t) - F.lit(273.15), 2)


def parse_mw(c) -> Column:
    """P10: trim, decimal comma -> dot, blanks removed; unparsable -> 0.0."""
    txt = F.replace(F.replace(strip_ws(c), F.lit(","), F.lit(".")), F.lit(" "), F.lit(""))
    return F.coalesce(nan_to_null(_try_double(txt)), F.lit(0.0))


# What the reference's float() accepts, less digit separators: Java's suffixes (100d) and hexadecimal floats are text.
NUMBER = r"(?i)^[+-]?(\d+\.?\d*(e[+-]?\d+)?|\.\d+(e[+-]?\d+)?|inf|infinity|nan)$"


def _try_double(c: Column) -> Column:
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def canonical_region_code(c) -> Column:
    """P12: '11.0' -> '11'; NULL for blank, unparsable or 0 (caller filters)."""
    num = _try_double(strip_ws(as_col(c).cast("string")))
    # towards zero, then exact; numbers of more than 38 digits have no code
    code = (num - num % 1).try_cast("decimal(38,0)").cast("string")
    return F.when(num.isNull() | F.isnan(num) | (code == "0"), None).otherwise(code)


def kw_to_mw(c) -> Column:
    """kW text (padding and decimal comma accepted) -> MW; unparsable -> NULL (summed as absent)."""
    return nan_to_null(_try_double(F.replace(strip_ws(as_col(c).cast("string")), F.lit(","), F.lit(".")))) / 1000.0


def js_round(c, digits: int = 0) -> Column:
    """Round half toward +infinity (the dashboard's rounding)."""
    if digits == 0:
        return F.floor(as_col(c) + F.lit(0.5)).cast("double")
    scale = float(10 ** digits)
    return F.floor(as_col(c) * scale + F.lit(0.5)) / scale


def end_of_day_bound(value: str | None):
    """A 10-character date bound means 'through the end of that day'.

    Returns ``(timestamp_literal, inclusive)``: date-only input gives the next
    midnight as an exclusive bound, anything else is an inclusive instant.
    """
    if value is None:
        return None, True
    if len(value) == 10:
        return F.date_add(F.lit(value).cast("date"), 1).cast("timestamp_ntz"), False
    return F.lit(value).cast("timestamp_ntz"), True


def normalize_name(name: str, fold_accents: bool = False) -> str:
    """P05 (driver-side, on column *names* only): lower, blanks and dashes -> '_'.

    The extended form (capacity registers) first trims, then folds the
    accents listed in ``NAME_ACCENT_FOLD`` and drops parentheses.
    """
    out = name.lower()
    if fold_accents:
        out = out.strip()
    out = out.replace(" ", "_").replace("-", "_")
    if fold_accents:
        for a, b in NAME_ACCENT_FOLD.items():
            out = out.replace(a, b)
        out = out.replace("(", "").replace(")", "")
    return out


def json_safe(df, ts_format: str = "yyyy-MM-dd'T'HH:mm:ss"):
    """Timestamps -> ISO text, decimals -> double; NULLs kept (API-ready rows)."""
    from pyspark.sql import functions as _F
    cols = []
    for name, t in df.dtypes:
        if t.startswith("timestamp") or t == "date":
            cols.append(_F.date_format(_F.col(name), ts_format).alias(name))
        elif t.startswith("decimal"):
            cols.append(_F.col(name).cast("double").alias(name))
        else:
            cols.append(_F.col(name))
    return df.select(*cols)
