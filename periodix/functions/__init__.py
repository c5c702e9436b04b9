from periodix.functions.columns import (  # noqa: F401
    basename,
    fmt_fixed,
    guarded_pct,
    py_strip,
    quarter_from_sheet,
    quarter_label,
    to_number,
    weighted_mean,
    year_of_quarter,
)
