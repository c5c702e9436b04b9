"""ANSI-SQL (DuckDB dialect) statements of the registered queries.

They run on the same parquet tables (pre-registered views) and are the
independent oracle for ``plans/catalog.py``.  The shared CTEs below define
the filings panel exactly as ``sources/panel.py`` builds it.
"""

from __future__ import annotations

from periodix.functions.columns import PY_WHITESPACE_CLASS

PANEL_CTES = """
li AS (
  SELECT l.l_suppkey AS suppkey, s.s_name AS mfo_name,
         CAST(year(l.l_shipdate) AS INTEGER) AS year, CAST(quarter(l.l_shipdate) AS INTEGER) AS qtr,
         l.l_linenumber AS ln,
         CAST(l.l_extendedprice AS DECIMAL(18,2)) AS px,
         ROUND(CAST(l.l_extendedprice AS DECIMAL(18,2))
               * (CAST(1 AS DECIMAL(4,2)) - CAST(l.l_discount AS DECIMAL(4,2))), 2) AS net,
         ROUND(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_discount AS DECIMAL(4,2)), 2) AS disc,
         ROUND(CAST(l.l_extendedprice AS DECIMAL(18,2)) * CAST(l.l_tax AS DECIMAL(4,2)), 2) AS tax
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey),
raw AS (
  SELECT mfo_name, year, qtr, MIN(suppkey) AS suppkey,
         SUM(px) AS px, SUM(net) AS net,
         SUM(CASE WHEN ln = 5 THEN net END) AS d1,
         SUM(CASE WHEN ln = 6 THEN net END) AS d2,
         SUM(CASE WHEN ln = 7 THEN net END) AS d3,
         SUM(disc) AS disc, SUM(tax) AS tax
  FROM li GROUP BY mfo_name, year, qtr),
parsed AS (
  SELECT CAST(suppkey AS VARCHAR) AS no, mfo_name, CAST(px AS DOUBLE) AS assets,
         CASE WHEN year < 1998 THEN CAST(net AS DOUBLE) END AS net_loans,
         CASE WHEN year >= 1998 THEN CAST(net AS DOUBLE) END AS portfolio_gross,
         CASE WHEN year >= 1998 THEN CAST(d1 AS DOUBLE) END AS del_31_60,
         CASE WHEN year >= 1998 THEN CAST(d2 AS DOUBLE) END AS del_61_90,
         CASE WHEN year >= 1998 THEN CAST(d3 AS DOUBLE) END AS del_90_plus,
         CAST(disc AS VARCHAR) AS liabilities, CAST(px - disc AS VARCHAR) AS equity,
         CASE WHEN year >= 1998 THEN CAST(tax AS VARCHAR) END AS profit,
         CASE WHEN year < 1998 THEN 'old' ELSE 'new' END AS format,
         printf('%04d-%02d-01', year, (qtr - 1) * 3 + 1) AS quarter, year,
         'filings_' || CAST(year AS VARCHAR) || CASE WHEN qtr <= 2 THEN '_h1' ELSE '_h2' END || '.xlsx' AS file
  FROM raw),
filings AS (
  SELECT no, mfo_name, assets, net_loans,
         CASE WHEN format = 'old' THEN net_loans / 0.92 ELSE portfolio_gross END AS portfolio_gross,
         CASE WHEN format = 'old' THEN (net_loans / 0.92 - net_loans) * 0.1 ELSE del_31_60 END AS del_31_60,
         CASE WHEN format = 'old' THEN (net_loans / 0.92 - net_loans) * 0.1 ELSE del_61_90 END AS del_61_90,
         CASE WHEN format = 'old' THEN (net_loans / 0.92 - net_loans) * 0.8 ELSE del_90_plus END AS del_90_plus,
         liabilities, equity, profit, format, quarter, year, file
  FROM parsed
  WHERE mfo_name IS NOT NULL AND assets IS NOT NULL
    AND (CASE WHEN format = 'old' THEN net_loans / 0.92 ELSE portfolio_gross END) IS NOT NULL),
enriched AS (
  SELECT *, del_31_60 + del_61_90 + del_90_plus AS over30, del_90_plus AS npl,
         CASE WHEN portfolio_gross > 0
              THEN (del_31_60 + del_61_90 + del_90_plus) / portfolio_gross * 100 END AS over30_pct,
         CASE WHEN portfolio_gross > 0 THEN del_90_plus / portfolio_gross * 100 END AS npl_pct
  FROM filings),
shared AS (
  SELECT *,
         CAST(sum(CAST(assets AS DECIMAL(28,6))) OVER (
                PARTITION BY quarter ORDER BY assets DESC, mfo_name ASC, file ASC, no ASC
                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE)
           / NULLIF(CAST(sum(CAST(assets AS DECIMAL(28,6))) OVER (PARTITION BY quarter) AS DOUBLE), 0)
           AS cumulative_share
  FROM enriched),
marked AS (
  SELECT *, coalesce(cumulative_share <= 0.8, false) AS is_leader FROM shared)
"""

# Market aggregate columns (A1) over any grouping; {w} = weighted NPL.
WEIGHTED_NPL = (
    "sum(CASE WHEN npl_pct IS NOT NULL AND portfolio_gross IS NOT NULL THEN npl_pct * portfolio_gross END)"
    " / NULLIF(sum(CASE WHEN npl_pct IS NOT NULL AND portfolio_gross IS NOT NULL"
    " THEN portfolio_gross END), 0)"
)
MARKET_AGGS = f"""count(DISTINCT mfo_name) AS mfo_count,
       coalesce(sum(assets), 0.0) AS total_assets,
       coalesce(sum(portfolio_gross), 0.0) AS total_portfolio,
       coalesce(sum(npl), 0.0) AS total_npl,
       {WEIGHTED_NPL} AS avg_npl_pct"""
SEGMENT_AGGS = f"""count(DISTINCT mfo_name) AS mfo_count,
       coalesce(sum(assets), 0.0) AS total_assets,
       coalesce(sum(portfolio_gross), 0.0) AS total_portfolio,
       {WEIGHTED_NPL} AS avg_npl_pct"""

# Python str.strip() in RE2 syntax: same code points as the Spark helper.
STRIP_RE = r"\A" + PY_WHITESPACE_CLASS + r"+|" + PY_WHITESPACE_CLASS + r"+\z"


def with_panel(body: str) -> str:
    return "WITH " + PANEL_CTES.strip() + ",\nq AS (\n" + body.strip() + "\n)\n"


def rounded(body: str, money: tuple[str, ...] = (), ratio: tuple[str, ...] = (),
            columns: list[str] | None = None, panel: bool = True) -> str:
    """Wrap a query body and round money to 2, ratios to 6 decimals."""
    head = with_panel(body) if panel else "WITH q AS (\n" + body.strip() + "\n)\n"
    repl = [f"round({c}, 2) AS {c}" for c in money] + [f"round({c}, 6) AS {c}" for c in ratio]
    sel = "*" + (f" REPLACE ({', '.join(repl)})" if repl else "")
    if columns:
        sel = ", ".join(
            f"round({c}, 2) AS {c}" if c in money else f"round({c}, 6) AS {c}" if c in ratio else c
            for c in columns
        )
    return head + f"SELECT {sel} FROM q"
