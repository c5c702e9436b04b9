"""Named results over one persisted panel.

``compute_all`` builds the reference's four aggregates (plus the quarterly
and change tables) as lazy DataFrames over a single ``persist``ed leader-marked
panel, so every result reuses one scan.  Nothing is collected; a "preview" is
an ordered ``limit`` and a "structured query" an equality filter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periodix.operators import aggregates as agg
from periodix.operators import changes, leaders, metrics, rankings

Strategy = Callable[[DataFrame], DataFrame]

# Name -> strategy; extend by adding an entry.
STRATEGIES: dict[str, Strategy] = {
    "yearly_market": agg.yearly_market,
    "yearly_leaders": lambda df: agg.yearly_segment(df, True),
    "yearly_non_leaders": lambda df: agg.yearly_segment(df, False),
    "top_mfos": lambda df: rankings.top_n(df, n=10),
    "quarterly_market": agg.quarterly_market,
    "quarterly_segments": agg.quarterly_segments,
    "npl_changes": changes.npl_changes_market,
}

# How each result is previewed (rows, total order).  A result that is
# not listed is shown whole, ordered by all of its columns.
PREVIEW = {
    "raw": (100, ["quarter", "mfo_name", "file", "no"]),
    "top_mfos": (20, ["year", "rank"]),
    "yearly_market": (None, ["year"]),
    "yearly_leaders": (None, ["year"]),
    "yearly_non_leaders": (None, ["year"]),
    "quarterly_market": (None, ["quarter"]),
    "quarterly_segments": (None, ["quarter", "segment"]),
    "npl_changes": (None, ["quarter"]),
}


def prepare(filings: DataFrame, persist: bool = True) -> DataFrame:
    """P14/P15 + W1/W2 on the normalised filings; persisted for reuse.

    ``MEMORY_AND_DISK`` blocks lost with an executor are recomputed from
    lineage, so a lost executor costs time, not correctness.  The caller
    releases a persisted panel with ``unpersist()``.
    """
    marked = leaders.mark_leaders(metrics.enrich_metrics(filings))
    return marked.persist(StorageLevel.MEMORY_AND_DISK) if persist else marked


def compute_all(marked: DataFrame, strategies: dict[str, Strategy] | None = None,
                names: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """Every strategy (or the ``names`` subset) on the same prepared panel."""
    out = {"raw": marked}
    for name, fn in (strategies or STRATEGIES).items():
        if names is None or name in names:
            out[name] = fn(marked)
    return out


def preview(results: dict[str, DataFrame], name: str, n: int | None = None) -> DataFrame:
    """First ``n`` rows of a result in a stated total order."""
    df = results[name]
    default_n, order = PREVIEW.get(name, (None, df.columns))
    n = default_n if n is None else n
    ordered = df.orderBy(*[c for c in order if c in df.columns])
    return ordered.limit(n) if n is not None else ordered


def structured_query(results: dict[str, DataFrame], name: str, **filters) -> DataFrame:
    """A named result with one equality filter per keyword."""
    if name not in results:
        raise KeyError(f"unknown result {name!r}; have {sorted(results)}")
    out = results[name]
    for col, val in filters.items():
        out = out.filter(F.col(col) == F.lit(val))
    return out
