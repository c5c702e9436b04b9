"""Column-expression helpers (all JVM-side, no Python UDFs).

Each helper returns a ``Column`` so it composes inside one projection and
stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values (must equal the reference for equal results) -------------
# Reporting date inside a sheet name: "01.MM.20YY", unanchored, first match.
SHEET_DATE_PATTERN = r"01\.(\d{2})\.20(\d{2})"
# Header cell marker (second column, lower-cased, substring).
HEADER_MARKER = "наименование"
# Layout row terms that mark the bucketed (new) layout; substring match.
BUCKET_TERMS = ["31", "60", "90", "просрочен"]
# A data row starts with a serial number.
SERIAL_PATTERN = r"^\d+$"
# Old-layout imputation constants: net loans are 92 % of gross, reserves are
# split 10 % / 10 % / 80 % over the 31-60 / 61-90 / 90+ buckets.
NET_TO_GROSS = 0.92
RESERVE_SPLIT = (0.1, 0.1, 0.8)
# Leader threshold on cumulative asset share (inclusive).
LEADER_THRESHOLD = 0.80
# Money is shown in billions.
BILLION = 1e9
# Characters Python's str.strip() removes (str.isspace), as one regex class.
PY_WHITESPACE_CLASS = (
    r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# ---------------------------------------------------------------------------

# Lenient numeric text: what pandas.to_numeric(errors="coerce") accepts and
# Spark's cast also accepts.  Spark alone would also take "1d", "1f", "nan".
_NUMERIC_TEXT = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"


def quarter_from_sheet(sheet: Column) -> Column:
    """``'01.04.2023'`` -> ``'2023-04-01'``; no match -> NULL."""
    month = F.regexp_extract(sheet, SHEET_DATE_PATTERN, 1)
    yy = F.regexp_extract(sheet, SHEET_DATE_PATTERN, 2)
    return F.when(month != "", F.concat(F.lit("20"), yy, F.lit("-"), month, F.lit("-01")))


def year_of_quarter(quarter: Column) -> Column:
    """Year of an ISO quarter string; an impossible date gives NULL."""
    return F.year(F.try_to_date(quarter, "yyyy-MM-dd"))


def quarter_label(year: Column, quarter_no: Column) -> Column:
    """ISO first day of a calendar quarter from (year, 1..4)."""
    month = (quarter_no - 1) * 3 + 1
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-01"))


def to_number(text: Column) -> Column:
    """P10: lenient numeric coercion -- unparsable text becomes NULL."""
    return F.when(text.rlike(_NUMERIC_TEXT), F.trim(text).try_cast("double"))


def guarded_pct(part: Column, whole: Column, on_zero: str = "null") -> Column:
    """``part / whole * 100`` when ``whole > 0``.

    ``on_zero="null"`` leaves the ratio missing (pipeline behaviour),
    ``on_zero="zero"`` returns 0.0 (record-class behaviour).
    """
    pct = F.when(whole > 0, part / whole * 100)
    if on_zero == "zero":
        return pct.otherwise(F.lit(0.0))
    if on_zero != "null":
        raise ValueError("on_zero must be 'null' or 'zero'")
    return pct


def weighted_mean(value: str, weight: str) -> Column:
    """A3: sum(value*weight)/sum(weight) over rows where both are present."""
    both = F.col(value).isNotNull() & F.col(weight).isNotNull()
    num = F.sum(F.when(both, F.col(value) * F.col(weight)))
    den = F.sum(F.when(both, F.col(weight)))
    return F.try_divide(num, den)


def py_strip(text: Column) -> Column:
    """Python ``str.strip()`` semantics (Unicode whitespace, both ends)."""
    ws = PY_WHITESPACE_CLASS
    return F.regexp_replace(text, rf"\A{ws}+|{ws}+\z", "")


def fmt_fixed(x: Column, decimals: int) -> Column:
    """``f"{x:.Nf}"`` -- half-even on the exact binary value, no grouping."""
    pattern = "0." + "0" * decimals if decimals > 0 else "0"
    return F.call_function("format_number", x, F.lit(pattern))


def fmt_thousands(x: Column) -> Column:
    """``f"{x:,.0f}"``: whole numbers in groups of three."""
    return F.call_function("format_number", x, F.lit("#,##0"))


def basename(path: Column) -> Column:
    """Last path segment (file lineage)."""
    return F.element_at(F.split(path, "/"), -1)
