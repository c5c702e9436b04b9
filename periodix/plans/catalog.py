"""Registered queries: one Spark builder and one SQL oracle per name.

Each builder takes ``(spark, sf_dir)``, reads the driver tables (or data
Spark derives from them) in full, and returns a lazy DataFrame.  Money is
rounded to 2 and ratios to 6 decimals at the query edge, identically in the
SQL, so both engines agree to the last printed digit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from periodix.operators import aggregates as agg
from periodix.operators import changes, leaders, metrics, rankings
from periodix.operators.normalise import union_layouts
from periodix.plans import sql as S
from periodix.sources import panel
from periodix.sources.tables import read_table

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    money: tuple[str, ...] = ()
    ratio: tuple[str, ...] = ()
    ops: str = ""

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(spark, sf_dir)
        edge = {c: F.round(c, 2) for c in self.money if c in df.columns}
        edge.update({c: F.round(c, 6) for c in self.ratio if c in df.columns})
        return df.withColumns(edge) if edge else df


REGISTRY: dict[str, Query] = {}


def register(name: str, build: Builder, sql: str | None, money=(), ratio=(), ops: str = "") -> None:
    REGISTRY[name] = Query(name, build, sql, tuple(money), tuple(ratio), ops)


# --- shared panel stages ----------------------------------------------------

# Lazy plans (not data) of the shared panel stages, per application and
# scale: building them costs thousands of py4j calls, executing them is
# unaffected -- every query still runs from the parquet tables.
_PLANS: dict[tuple, DataFrame] = {}


def _plan(kind: str, spark: SparkSession, sf: str, build: Callable[[], DataFrame]) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf, kind)
    if key not in _PLANS:
        _PLANS[key] = build()
    return _PLANS[key]


def filings(spark: SparkSession, sf: str) -> DataFrame:
    return _plan("filings", spark, sf, lambda: panel.filings_panel(spark, sf))


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return _plan("enriched", spark, sf, lambda: metrics.enrich_metrics(filings(spark, sf)))


def marked(spark: SparkSession, sf: str) -> DataFrame:
    return _plan("marked", spark, sf, lambda: leaders.mark_leaders(enriched(spark, sf)))


def marked_of(spark: SparkSession, sf: str, year: int) -> DataFrame:
    """One year's panel: shares are per quarter, so other years are not read."""
    return leaders.mark_leaders(metrics.enrich_metrics(panel.filings_panel(spark, sf, year)))


MONEY_ROW = ("assets", "net_loans", "portfolio_gross", "del_31_60", "del_61_90", "del_90_plus",
             "over30", "npl")
PCT_ROW = ("over30_pct", "npl_pct", "cumulative_share")
FILING_COLS = ["no", "mfo_name", "assets", "net_loans", "portfolio_gross", "del_31_60",
               "del_61_90", "del_90_plus", "liabilities", "equity", "profit", "format",
               "quarter", "year", "file"]
MARKET_MONEY = ("total_assets", "total_portfolio", "total_npl")

# --- 1. panel, metrics, union (P11, P13, P14, P15, U1) -------------------------

register(
    "filings_panel", filings,
    S.rounded("SELECT * FROM filings", money=MONEY_ROW[:6]),
    money=MONEY_ROW[:6], ops="P11 P12 P13 U1",
)
register(
    "union_layouts", lambda sp, sf: union_layouts(*panel.filing_layouts(sp, sf)),
    S.rounded("SELECT * FROM parsed", money=MONEY_ROW[:6]),
    money=MONEY_ROW[:6], ops="U1",
)
register(
    "impute_old_layout",
    lambda sp, sf: metrics.impute_old_layout(panel.filings_parsed(sp, sf)).filter(F.col("format") == "old"),
    S.rounded("SELECT * FROM filings WHERE format = 'old'", money=MONEY_ROW[:6]),
    money=MONEY_ROW[:6], ops="P11",
)
register(
    "enriched", enriched,
    S.rounded("SELECT * FROM enriched", money=MONEY_ROW, ratio=PCT_ROW[:2]),
    money=MONEY_ROW, ratio=PCT_ROW[:2], ops="P14 P15",
)
register(
    "enriched_zero_guard",
    # every 11th firm's portfolio is set to zero, so that both branches are taken
    lambda sp, sf: metrics.enrich_metrics(filings(sp, sf).withColumn(
        "portfolio_gross", F.when(F.col("no").cast("int") % 11 == 0, 0.0).otherwise(F.col("portfolio_gross"))), on_zero="zero")
    .select("mfo_name", "quarter", "over30_pct", "npl_pct"),
    S.rounded("""SELECT mfo_name, quarter,
        CASE WHEN portfolio_gross > 0 THEN (del_31_60 + del_61_90 + del_90_plus) / portfolio_gross * 100
             ELSE 0.0 END AS over30_pct,
        CASE WHEN portfolio_gross > 0 THEN del_90_plus / portfolio_gross * 100 ELSE 0.0 END AS npl_pct
        FROM (SELECT * REPLACE (CASE WHEN CAST(no AS INTEGER) % 11 = 0 THEN 0.0 ELSE portfolio_gross END
                                AS portfolio_gross) FROM filings)""", ratio=("over30_pct", "npl_pct")),
    ratio=("over30_pct", "npl_pct"), ops="P15b",
)

def _dedupe(spark: SparkSession, sf: str) -> DataFrame:
    from periodix.operators.normalise import dedupe_filings

    f = filings(spark, sf)
    # every filing arrives a second time in an earlier "amended" file
    copies = f.withColumn("file", F.concat(F.lit("amended_"), F.col("file")))
    return dedupe_filings(f.unionByName(copies))


register(
    "dedupe_filings", _dedupe,
    S.rounded("SELECT * FROM filings", money=MONEY_ROW[:6]),
    money=MONEY_ROW[:6], ops="U1/U2 opt-in dedupe",
)

# --- 2. leaders (W1, W2) ------------------------------------------------------

_LEADER_SQL = S.rounded(
    "SELECT mfo_name, quarter, year, assets, cumulative_share, is_leader FROM marked",
    money=("assets",), ratio=("cumulative_share",),
)
register(
    "leaders",
    lambda sp, sf: marked(sp, sf).select("mfo_name", "quarter", "year", "assets",
                                                          "cumulative_share", "is_leader"),
    _LEADER_SQL, money=("assets",), ratio=("cumulative_share",), ops="W1 W2 J1 T3",
)
register(
    "running_share_ranged",
    lambda sp, sf: marked(sp, sf).select(
        "mfo_name", "quarter", "year", "assets", "cumulative_share", "is_leader"),
    _LEADER_SQL, money=("assets",), ratio=("cumulative_share",), ops="W1 W2 (earlier name of the same path)",
)

# --- 3. aggregates (A1-A4, A10, A11, A13, J2) -----------------------------------

register(
    "yearly_market", lambda sp, sf: agg.yearly_market(enriched(sp, sf)),
    S.rounded(f"SELECT year, {S.MARKET_AGGS} FROM marked GROUP BY year",
              money=MARKET_MONEY, ratio=("avg_npl_pct",)),
    money=MARKET_MONEY, ratio=("avg_npl_pct",), ops="A1 A3 A4 X1",
)
register(
    "quarterly_market", lambda sp, sf: agg.quarterly_market(enriched(sp, sf)),
    S.rounded(f"SELECT quarter, year, {S.MARKET_AGGS} FROM marked GROUP BY quarter, year",
              money=MARKET_MONEY, ratio=("avg_npl_pct",)),
    money=MARKET_MONEY, ratio=("avg_npl_pct",), ops="A10",
)
_SEG = "CASE WHEN is_leader THEN 'leaders' ELSE 'non_leaders' END"
register(
    "yearly_segments", lambda sp, sf: agg.yearly_segments(marked(sp, sf)),
    S.rounded(f"SELECT year, {_SEG} AS segment, {S.SEGMENT_AGGS} FROM marked GROUP BY year, is_leader",
              money=MARKET_MONEY[:2], ratio=("avg_npl_pct",)),
    money=MARKET_MONEY[:2], ratio=("avg_npl_pct",), ops="A2 P16 P22",
)
register(
    "yearly_leaders", lambda sp, sf: agg.yearly_segment(marked(sp, sf), True),
    S.rounded(f"SELECT year, 'leaders' AS segment, {S.SEGMENT_AGGS} FROM marked WHERE is_leader GROUP BY year",
              money=MARKET_MONEY[:2], ratio=("avg_npl_pct",)),
    money=MARKET_MONEY[:2], ratio=("avg_npl_pct",), ops="A2 P16",
)
register(
    "yearly_non_leaders", lambda sp, sf: agg.yearly_segment(marked(sp, sf), False),
    S.rounded(f"SELECT year, 'non_leaders' AS segment, {S.SEGMENT_AGGS} FROM marked "
              "WHERE NOT is_leader GROUP BY year",
              money=MARKET_MONEY[:2], ratio=("avg_npl_pct",)),
    money=MARKET_MONEY[:2], ratio=("avg_npl_pct",), ops="A2 P16",
)
register(
    "quarterly_segments", lambda sp, sf: agg.quarterly_segments(marked(sp, sf)),
    S.rounded(f"SELECT quarter, year, {_SEG} AS segment, {S.SEGMENT_AGGS} FROM marked "
              "GROUP BY quarter, year, is_leader",
              money=MARKET_MONEY[:2], ratio=("avg_npl_pct",)),
    money=MARKET_MONEY[:2], ratio=("avg_npl_pct",), ops="A10 (segments)",
)
register(
    "market_and_segments", lambda sp, sf: agg.market_and_segments(marked(sp, sf)),
    S.rounded(f"""SELECT year, 'market' AS segment, {S.MARKET_AGGS} FROM marked GROUP BY year
        UNION ALL
        SELECT year, {_SEG} AS segment, {S.MARKET_AGGS} FROM marked GROUP BY year, is_leader""",
              money=MARKET_MONEY, ratio=("avg_npl_pct",)),
    money=MARKET_MONEY, ratio=("avg_npl_pct",), ops="A1+A2 grouping sets",
)


def _seg_cols(flag: str, name: str) -> str:
    c = f"is_leader = {flag}"
    return f"""CASE WHEN count_if({c}) > 0 THEN count(DISTINCT CASE WHEN {c} THEN mfo_name END) END
               AS {name}_mfo_count,
           sum(CASE WHEN {c} THEN assets END) AS {name}_assets,
           sum(CASE WHEN {c} THEN portfolio_gross END) AS {name}_portfolio,
           sum(CASE WHEN {c} AND npl_pct IS NOT NULL AND portfolio_gross IS NOT NULL
                    THEN npl_pct * portfolio_gross END)
             / NULLIF(sum(CASE WHEN {c} AND npl_pct IS NOT NULL AND portfolio_gross IS NOT NULL
                          THEN portfolio_gross END), 0) AS {name}_npl_pct"""


_PIVOT_MONEY = ("leaders_assets", "leaders_portfolio", "non_leaders_assets", "non_leaders_portfolio")
_PIVOT_PCT = ("leaders_npl_pct", "non_leaders_npl_pct", "npl_gap")
register(
    "segment_pivot", lambda sp, sf: agg.segment_pivot(marked(sp, sf)),
    S.rounded(f"""SELECT *, leaders_npl_pct - non_leaders_npl_pct AS npl_gap FROM (
        SELECT year, {_seg_cols('true', 'leaders')}, {_seg_cols('false', 'non_leaders')}
        FROM marked GROUP BY year)""", money=_PIVOT_MONEY, ratio=_PIVOT_PCT),
    money=_PIVOT_MONEY, ratio=_PIVOT_PCT, ops="J2",
)
register(
    "weighted_avg_npl", lambda sp, sf: agg.weighted_avg_npl(enriched(sp, sf)),
    S.rounded(f"""SELECT year, format, count(*) AS n_rows, count(npl_pct) AS n_weighted,
        {S.WEIGHTED_NPL} AS avg_npl_pct FROM enriched GROUP BY year, format""", ratio=("avg_npl_pct",)),
    ratio=("avg_npl_pct",), ops="A3",
)
_NUM_RE = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"
_PROFIT = f"CASE WHEN regexp_matches(profit, '{_NUM_RE}') THEN TRY_CAST(trim(profit) AS DOUBLE) END"
register(
    "profitability", lambda sp, sf: agg.profitability(enriched(sp, sf)),
    S.rounded(f"""SELECT year,
        count_if({_PROFIT} IS NOT NULL AND portfolio_gross IS NOT NULL) AS n_rows,
        sum(CASE WHEN portfolio_gross IS NOT NULL THEN {_PROFIT} END) AS total_profit,
        sum(CASE WHEN portfolio_gross IS NOT NULL THEN {_PROFIT} END)
          / NULLIF(sum(CASE WHEN {_PROFIT} IS NOT NULL THEN portfolio_gross END), 0) * 100 AS profit_pct
        FROM enriched GROUP BY year""", money=("total_profit",), ratio=("profit_pct",)),
    money=("total_profit",), ratio=("profit_pct",), ops="A11 P10",
)
register(
    "npl_drivers", lambda sp, sf: agg.npl_drivers(enriched(sp, sf), n=10),
    S.rounded("""SELECT year, mfo_name, npl, year_npl, npl_share, rank FROM (
        SELECT *, npl / NULLIF(year_npl, 0) AS npl_share,
               CAST(row_number() OVER (PARTITION BY year ORDER BY npl DESC, mfo_name ASC) AS INTEGER) AS rank
        FROM (SELECT year, mfo_name, coalesce(sum(npl), 0.0) AS npl FROM marked GROUP BY year, mfo_name) p
        JOIN (SELECT year AS y2, sum(npl) AS year_npl FROM
              (SELECT year, mfo_name, coalesce(sum(npl), 0.0) AS npl FROM marked GROUP BY year, mfo_name)
              GROUP BY year) t ON p.year = t.y2) WHERE rank <= 10""",
              money=("npl", "year_npl"), ratio=("npl_share",)),
    money=("npl", "year_npl"), ratio=("npl_share",), ops="A13",
)
register(
    "source_attribution", lambda sp, sf: agg.source_attribution(enriched(sp, sf)),
    S.rounded("SELECT year, file, count(*) AS n_records FROM marked GROUP BY year, file"),
    ops="R14",
)

# --- 4. rankings (T1, T2, P17, W3) --------------------------------------------

_TOP_SQL = """SELECT mfo_name, year, quarter, assets, portfolio_gross, npl_pct, is_leader{extra},
       CAST(rank AS INTEGER) AS rank FROM (
  SELECT m.*, row_number() OVER (PARTITION BY m.year ORDER BY {metric} DESC, mfo_name ASC, file ASC) AS rank
  FROM marked m JOIN (SELECT year, max(quarter) AS lq FROM marked GROUP BY year) l
    ON m.year = l.year AND m.quarter = l.lq) WHERE rank <= {n}"""
register(
    "top_n", lambda sp, sf: rankings.top_n(marked(sp, sf), n=10),
    S.rounded(_TOP_SQL.format(metric="assets", n=10, extra=""),
              money=("assets", "portfolio_gross"), ratio=("npl_pct",)),
    money=("assets", "portfolio_gross"), ratio=("npl_pct",), ops="T1 W3 P17 P20",
)
register(
    "top_n_by_portfolio", lambda sp, sf: rankings.top_n(marked(sp, sf), n=5, metric="portfolio_gross"),
    S.rounded(_TOP_SQL.format(metric="portfolio_gross", n=5, extra=""),
              money=("assets", "portfolio_gross"), ratio=("npl_pct",)),
    money=("assets", "portfolio_gross"), ratio=("npl_pct",), ops="T2",
)
register(
    "top_chart_frame", lambda sp, sf: rankings.top_chart_frame(marked_of(sp, sf, 2000), 2000),
    S.rounded("""SELECT rank, mfo_name, quarter, assets / 1e9 AS assets_bn, npl_pct, is_leader FROM ("""
              + _TOP_SQL.format(metric="assets", n=10, extra="") + """) WHERE year = 2000""",
              ratio=("assets_bn", "npl_pct")),
    ratio=("assets_bn", "npl_pct"), ops="P18 T4 P21",
)
register(
    "top_table", lambda sp, sf: rankings.top_table(marked_of(sp, sf, 2000), 2000),
    S.rounded("SELECT rank, mfo_name, assets, npl_pct, is_leader FROM ("
              + _TOP_SQL.format(metric="assets", n=10, extra="") + ") WHERE year = 2000",
              money=("assets",), ratio=("npl_pct",)),
    money=("assets",), ratio=("npl_pct",), ops="P20 T4 P18",
)
register(
    "latest_period",
    lambda sp, sf: agg.latest_period(enriched(sp, sf)).select("mfo_name", "quarter", "year", "assets"),
    S.rounded("""SELECT m.mfo_name, m.quarter, m.year, m.assets FROM marked m
        JOIN (SELECT year, max(quarter) AS lq FROM marked GROUP BY year) l
        ON m.year = l.year AND m.quarter = l.lq""", money=("assets",)),
    money=("assets",), ops="P17 A5 J1",
)

# --- 5. changes (W4, W5) --------------------------------------------------------

_Q_MARKET = f"SELECT quarter, year, {S.WEIGHTED_NPL} AS avg_npl_pct FROM marked GROUP BY quarter, year"
register(
    "npl_changes_market", lambda sp, sf: changes.npl_changes_market(enriched(sp, sf)),
    S.rounded(f"""SELECT a.quarter, a.year, a.avg_npl_pct,
          lag(a.quarter) OVER (ORDER BY CAST(a.quarter AS DATE)) AS prev_quarter,
          a.avg_npl_pct - lag(a.avg_npl_pct) OVER (ORDER BY CAST(a.quarter AS DATE)) AS qoq_change,
          a.avg_npl_pct - b.avg_npl_pct AS yoy_change,
          (a.avg_npl_pct - lag(a.avg_npl_pct) OVER (ORDER BY CAST(a.quarter AS DATE)))
            / NULLIF(lag(a.avg_npl_pct) OVER (ORDER BY CAST(a.quarter AS DATE)), 0) AS qoq_rel
        FROM ({_Q_MARKET}) a LEFT JOIN ({_Q_MARKET}) b
          ON CAST(a.quarter AS DATE) = CAST(b.quarter AS DATE) + INTERVAL 12 MONTH""",
              ratio=("avg_npl_pct", "qoq_change", "yoy_change", "qoq_rel")),
    ratio=("avg_npl_pct", "qoq_change", "yoy_change", "qoq_rel"), ops="W4",
)
_ENTITY_CHANGES = """SELECT a.mfo_name, a.quarter, a.year, a.npl_pct,
          lag(a.quarter) OVER w AS prev_quarter,
          a.npl_pct - lag(a.npl_pct) OVER w AS qoq_change,
          a.npl_pct - b.npl_pct AS yoy_change,
          (a.npl_pct - lag(a.npl_pct) OVER w) / NULLIF(lag(a.npl_pct) OVER w, 0) AS qoq_rel
        FROM marked a LEFT JOIN marked b
          ON a.mfo_name = b.mfo_name AND CAST(a.quarter AS DATE) = CAST(b.quarter AS DATE) + INTERVAL 12 MONTH
        WINDOW w AS (PARTITION BY a.mfo_name ORDER BY CAST(a.quarter AS DATE))"""
_CHG = ("npl_pct", "qoq_change", "yoy_change", "qoq_rel")
register(
    "npl_changes_entity", lambda sp, sf: changes.npl_changes_entity(enriched(sp, sf)),
    S.rounded(_ENTITY_CHANGES, ratio=_CHG), ratio=_CHG, ops="W4 (entity)",
)
register(
    "deteriorating", lambda sp, sf: changes.deteriorating(enriched(sp, sf)),
    S.rounded(f"SELECT * FROM ({_ENTITY_CHANGES}) WHERE qoq_change > 0", ratio=_CHG),
    ratio=_CHG, ops="W5",
)

# --- 6. dashboard queries (A7-A9, P18-P24) --------------------------------------

register(
    "kpis", lambda sp, sf: agg.kpis(enriched(sp, sf)),
    S.rounded("SELECT count(*) AS n_records, count(DISTINCT mfo_name) AS n_mfos, "
              "min(year) AS min_year, max(year) AS max_year FROM marked"),
    ops="A7",
)
register(
    "latest_year_kpis", lambda sp, sf: agg.latest_year_kpis(enriched(sp, sf)),
    S.rounded("""SELECT year, avg(npl_pct) AS mean_npl_pct, sum(assets) / 1e9 AS total_assets_bn
        FROM marked WHERE year = (SELECT max(year) FROM marked) GROUP BY year""",
              ratio=("mean_npl_pct", "total_assets_bn")),
    ratio=("mean_npl_pct", "total_assets_bn"), ops="A8 P19 P21",
)
register(
    "years", lambda sp, sf: agg.years(enriched(sp, sf)),
    S.rounded("SELECT DISTINCT year FROM marked"), ops="A9",
)

# --- 7. ingest (S2, P1-P13, J4, P25) over grids rendered from the tables --------


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    from periodix.sources.grid import render_sheets, with_defects

    from periodix.session import ensure_checkpoint_dir

    # The grid is a union of renderings of the panel and is read twice by the
    # normaliser: written once to the shared checkpoint folder (7 s against
    # 37 s when each read derives it anew, sf0.1).
    ensure_checkpoint_dir(spark)
    return with_defects(render_sheets(panel.filings_parsed(spark, sf))).checkpoint(eager=True)


def _normalised(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from periodix.operators.normalise import normalise_sheets

    return normalise_sheets(_grid(spark, sf))


def _parse_quality(spark: SparkSession, sf: str) -> DataFrame:
    from periodix.operators.normalise import parse_quality

    return parse_quality(_grid(spark, sf))


# All years and both layouts go through the sheets; the rules of
# ``grid.with_defects`` are repeated here.
_SHIFTED = "CAST(year + 20 AS VARCHAR)"
_BAD_NUMBER = "CAST(no AS INTEGER) % 13 = 0"
_SHEETS_CTE = f"""s AS (
    SELECT *, '01.' || substr(quarter, 6, 2) || '.' || {_SHIFTED} AS sheet,
           NOT {_BAD_NUMBER} AND mfo_name IS NOT NULL AND assets IS NOT NULL
             AND coalesce(net_loans, portfolio_gross) IS NOT NULL AS good
    FROM parsed),
  january AS (SELECT *, '01.13.' || {_SHIFTED} AS sheet13 FROM s WHERE substr(quarter, 6, 2) = '01')"""
register(
    "sheet_normalise", lambda sp, sf: _normalised(sp, sf)[0],
    S.rounded(f"""SELECT * REPLACE ({_SHIFTED} || substr(quarter, 5) AS quarter, CAST(year + 20 AS INTEGER) AS year)
        FROM filings WHERE NOT {_BAD_NUMBER}""", money=MONEY_ROW[:6]),
    money=MONEY_ROW[:6], ops="S2 S3 P1-P13 J4",
)
register(
    "parse_quality", _parse_quality,
    S.rounded(f"""WITH {_SHEETS_CTE}
        SELECT file, sheet, count(*) AS rows_seen, count_if(good) AS rows_kept,
               count_if(NOT good) AS rows_incomplete, CAST(0 AS BIGINT) AS rows_quarantined,
               count_if(good) / count(*) AS accuracy FROM s GROUP BY 1, 2
        UNION ALL
        SELECT file, sheet13, count(*), CAST(0 AS BIGINT), CAST(0 AS BIGINT), count(*), 0.0 FROM january GROUP BY 1, 2
        UNION ALL
        SELECT 'narrow_' || file, sheet, count(*), CAST(0 AS BIGINT), CAST(0 AS BIGINT), count(*), 0.0
        FROM january GROUP BY 1, 2""", ratio=("accuracy",)),
    ratio=("accuracy",), ops="P25 P13",
)
register(
    "parse_errors", lambda sp, sf: _normalised(sp, sf)[1],
    S.rounded(f"""WITH {_SHEETS_CTE}
        SELECT file, sheet13 AS sheet, 'invalid reporting date: ' || {_SHIFTED} || '-13-01' AS error
        FROM january GROUP BY file, sheet13, year
        UNION ALL
        SELECT 'narrow_' || file, sheet, 'sheet narrower than layout: 5 < '
               || CASE WHEN format = 'old' THEN '6' ELSE '10' END FROM january GROUP BY file, sheet, format"""),
    ops="S4 P7 P8",
)

# --- 8. text: summary lines, chunks (R1-R3) --------------------------------------

from periodix.operators import retrieval as R  # noqa: E402
from periodix.operators import text as TX  # noqa: E402


def _summary_docs(spark: SparkSession, sf: str) -> DataFrame:
    return TX.summary_lines(agg.yearly_market(enriched(spark, sf)))


_SUMMARY_SQL = f"""
  SELECT 'summary_0' AS id, 0 AS line_no, 'Market Overview' AS text
  UNION ALL
  SELECT 'summary_' || CAST(row_number() OVER (ORDER BY year) AS VARCHAR) AS id,
         CAST(row_number() OVER (ORDER BY year) AS INTEGER) AS line_no,
         CAST(year AS VARCHAR) || ': ' || CAST(mfo_count AS VARCHAR) || ' MFOs, Assets '
           || printf('%.1f', total_assets / 1e9) || 'B KZT, NPL '
           || coalesce(printf('%.2f', avg_npl_pct), 'nan') || '%' AS text
  FROM (SELECT year, {S.MARKET_AGGS} FROM marked GROUP BY year)"""
register(
    "summary_lines", lambda sp, sf: _summary_docs(sp, sf).select("id", "line_no", "text"),
    S.rounded(_SUMMARY_SQL), ops="R1 R3 A12 P21",
)


def _doc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    docs = R.spread(read_table(spark, sf, "documents", "doc_id", "text", "lang", "source"))
    return TX.chunk_lines(docs, keep=("lang", "source"))


_CHUNKS_CTE = f"""chunks AS (
  SELECT doc_id, lang, source, CAST(i AS INTEGER) AS chunk_no, parts[i + 1] AS text FROM (
    SELECT doc_id, lang, source, parts, unnest(range(len(parts))) AS i FROM (
      SELECT doc_id, lang, source,
             list_filter(list_transform(string_split(text, chr(10)),
                                        lambda x: regexp_replace(x, '{S.STRIP_RE}', '', 'g')),
                         lambda x: x <> '') AS parts
      FROM documents)))"""
register(
    "chunks", lambda sp, sf: _doc_chunks(sp, sf).select("doc_id", "chunk_no", "text"),
    S.rounded(f"WITH {_CHUNKS_CTE} SELECT doc_id, chunk_no, text FROM chunks", panel=False),
    ops="R2 R3",
)

# --- 9. retrieval (R6-R9) ----------------------------------------------------------


def _cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    emb = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    cents = R.label_centroids(emb).select(F.col("label").alias("qid"), F.col("centroid").alias("vec"))
    return R.cosine_topk(R.spread(emb), cents, k=10).withColumn("rank", F.col("rank").cast("int"))


register(
    "cosine_topk", _cosine_topk,
    S.rounded("""
  WITH pos AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings),
  c AS (SELECT label, list(v ORDER BY i) AS centroid
        FROM (SELECT label, i, avg(CAST(x AS DOUBLE)) AS v FROM pos GROUP BY label, i) GROUP BY label),
  s AS (SELECT c.label AS qid, e.vec_id AS doc_id,
               list_cosine_similarity(c.centroid, CAST(e.embedding AS DOUBLE[])) AS similarity
        FROM c CROSS JOIN embeddings e)
  SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, doc_id) AS rank FROM s)
  WHERE rank <= 10""", ratio=("similarity",), panel=False),
    ratio=("similarity",), ops="R6 R7 T6 J3",
)

_TOK = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def _lexical_sql(doc_cte: str, doc_from: str, q_from: str, qid: str, k: int) -> str:
    return f"""WITH {doc_cte},
  dt AS (SELECT doc_id, chunk_no, token, count(*) AS d_tf FROM
         (SELECT doc_id, chunk_no, unnest({_TOK.format(t='text')}) AS token FROM {doc_from}) GROUP BY ALL),
  qt AS (SELECT {qid}, token, count(*) AS q_tf FROM
         (SELECT {qid}, unnest({_TOK.format(t='text')}) AS token FROM {q_from}) GROUP BY ALL),
  dn AS (SELECT doc_id, chunk_no, sqrt(sum(d_tf * d_tf)) AS d_norm FROM dt GROUP BY ALL),
  qn AS (SELECT {qid}, sqrt(sum(q_tf * q_tf)) AS q_norm FROM qt GROUP BY ALL),
  dots AS (SELECT {qid}, doc_id, chunk_no, sum(q_tf * d_tf) AS dot FROM qt JOIN dt USING (token) GROUP BY ALL),
  s AS (SELECT {qid}, doc_id, chunk_no, dot / (q_norm * d_norm) AS similarity
        FROM dots JOIN qn USING ({qid}) JOIN dn USING (doc_id, chunk_no)),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY {qid} ORDER BY similarity DESC, doc_id, chunk_no)
                       AS INTEGER) AS rank FROM s)
  SELECT {qid}, rank, doc_id, chunk_no, round(similarity, 6) AS similarity FROM r WHERE rank <= {k}"""


def _lexical_topk(spark: SparkSession, sf: str, **where: str) -> DataFrame:
    chunks = _doc_chunks(spark, sf)
    if where:
        chunks = R.metadata_filter(
            chunks.withColumn("metadata", F.create_map(F.lit("type"), F.lit("document"),
                                                       F.lit("lang"), F.col("lang"),
                                                       F.lit("source"), F.col("source"))),
            **where)
    bench = read_table(spark, sf, "benchmark", "item_id", "text")
    return R.lexical_topk(chunks.select("doc_id", "chunk_no", "text"), bench, 3,
                          ["doc_id", "chunk_no"], ["item_id"])


register(
    "lexical_topk", _lexical_topk,
    _lexical_sql(_CHUNKS_CTE, "chunks", "benchmark", "item_id", 3),
    ratio=("similarity",), ops="R7 R8",
)
register(
    "metadata_search", lambda sp, sf: _lexical_topk(sp, sf, type="document", lang="en"),
    _lexical_sql(_CHUNKS_CTE + ",\n en_chunks AS (SELECT * FROM chunks WHERE lang = 'en')",
                 "en_chunks", "benchmark", "item_id", 3),
    ratio=("similarity",), ops="R9",
)

# --- 9b. approximate search (R7b) ----------------------------------------------------

from periodix.operators import approximate as AN  # noqa: E402

ANN_K = 10


def _ann_sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as questions every one whose id is divisible by 20."""
    emb = read_table(spark, sf, "embeddings", "vec_id", "embedding")
    return R.spread(emb), emb.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))


def _lsh_topk(spark: SparkSession, sf: str) -> DataFrame:
    docs, asked = _ann_sides(spark, sf)
    return AN.approximate_topk(docs, asked, ANN_K, skip_same_id=True)


def _lsh_recall(spark: SparkSession, sf: str) -> DataFrame:
    """How many questions and exact hits there are, and whether the search by
    hashing finds nine in ten of those."""
    docs, asked = _ann_sides(spark, sf)
    exact = AN.exact_topk(docs, asked, ANN_K, skip_same_id=True)
    found = _lsh_topk(spark, sf).select("qid", "doc_id", F.lit(1).alias("_found"))
    return exact.join(found, ["qid", "doc_id"], "left").agg(
        F.countDistinct("qid").alias("n_questions"), F.count("*").alias("n_exact"),
        (F.avg(F.coalesce("_found", F.lit(0))) >= 0.9).alias("recall_ok"))


register("lsh_topk", lambda sp, sf: _lsh_topk(sp, sf).withColumn("rank", F.col("rank").cast("int")), None,
         ratio=("similarity",), ops="R7b")
register(
    "lsh_recall", _lsh_recall,
    S.rounded(f"""SELECT count(*) AS n_questions, CAST(sum(least({ANN_K}, n - 1)) AS BIGINT) AS n_exact, true AS recall_ok
        FROM embeddings, (SELECT count(*) AS n FROM embeddings) WHERE vec_id % 20 = 0""", panel=False),
    ops="R7b",
)

# --- 10. question answering (R10-R13, R15) and evaluation (R16) ------------------

from periodix.operators import evaluation as EV  # noqa: E402
from periodix.operators import routing as RT  # noqa: E402


def _chunk_docs(spark: SparkSession, sf: str) -> DataFrame:
    c = _doc_chunks(spark, sf)
    return c.select(F.concat(F.col("doc_id").cast("string"), F.lit("_"), F.col("chunk_no").cast("string"))
                    .alias("id"), "text")


def _user_turns(spark: SparkSession, sf: str) -> DataFrame:
    conv = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    return conv.filter(F.col("role") == "user").select(
        F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col("turn").cast("string")).alias("qid"),
        F.col("text").alias("question"),
    )


def _batch_qa(spark: SparkSession, sf: str) -> DataFrame:
    return R.answer_questions(_user_turns(spark, sf), _chunk_docs(spark, sf), k=2)


_NL2 = "chr(10) || chr(10)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_BEFORE, _REST = TX.PROMPT_TEMPLATE.split("{context}")
_BETWEEN, _AFTER = _REST.split("{question}")
_PROMPT_SQL = f"{_quoted(_BEFORE)} || coalesce(context, '') || {_quoted(_BETWEEN)} || question || {_quoted(_AFTER)}"


def _qa_sql(docs_cte: str, questions_cte: str, k: int) -> str:
    return f"""WITH {docs_cte},
  qs AS ({questions_cte}),
  dt AS (SELECT id, token, count(*) AS d_tf FROM
         (SELECT id, unnest({_TOK.format(t='text')}) AS token FROM docs) GROUP BY ALL),
  qt AS (SELECT qid, token, count(*) AS q_tf FROM
         (SELECT qid, unnest({_TOK.format(t='question')}) AS token FROM qs) GROUP BY ALL),
  dn AS (SELECT id, sqrt(sum(d_tf * d_tf)) AS d_norm FROM dt GROUP BY ALL),
  qn AS (SELECT qid, sqrt(sum(q_tf * q_tf)) AS q_norm FROM qt GROUP BY ALL),
  dots AS (SELECT qid, id, sum(q_tf * d_tf) AS dot FROM qt JOIN dt USING (token) GROUP BY ALL),
  s AS (SELECT qid, id, dot / (q_norm * d_norm) AS similarity FROM dots JOIN qn USING (qid) JOIN dn USING (id)),
  r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM s),
  ctx AS (SELECT qid, string_agg(d.text, {_NL2} ORDER BY r.rank) AS context
          FROM r JOIN docs d USING (id) WHERE rank <= {k} GROUP BY qid),
  a AS (SELECT qs.qid, qs.question, ctx.context FROM qs LEFT JOIN ctx USING (qid))
  SELECT qid, question, coalesce(context, '') AS context,
         'Context:' || chr(10) || coalesce(context, '') AS answer,
         {_PROMPT_SQL} AS prompt
  FROM a"""


_CHUNK_DOCS_CTE = _CHUNKS_CTE + """,
  docs AS (SELECT CAST(doc_id AS VARCHAR) || '_' || CAST(chunk_no AS VARCHAR) AS id, text FROM chunks)"""
_USER_TURNS_SQL = ("SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS qid, text AS question "
                   "FROM conversations WHERE role = 'user'")
register(
    "batch_qa", lambda sp, sf: _batch_qa(sp, sf).select("qid", "question", "context", "answer"),
    "SELECT qid, question, context, answer FROM ("
    + _qa_sql(_CHUNK_DOCS_CTE, _USER_TURNS_SQL, 2) + ")",
    ops="R15 R10 R12 S10",
)
register(
    "prompt", lambda sp, sf: _batch_qa(sp, sf).select("qid", "prompt"),
    "SELECT qid, prompt FROM (" + _qa_sql(_CHUNK_DOCS_CTE, _USER_TURNS_SQL, 2) + ")",
    ops="R11",
)


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The small result tables that questions are asked and answered from: the
    panel is computed once, its aggregates (a few rows a year; questions read
    each of them several times) are kept in the shared checkpoint folder."""
    from periodix.session import ensure_checkpoint_dir

    ensure_checkpoint_dir(spark)
    m = marked(spark, sf).checkpoint(eager=True)
    small = {"yearly": agg.yearly_market(m), "segments": agg.yearly_segments(m), "top": rankings.top_n(m, n=3),
             "sources": agg.source_attribution(m)}
    return {k: v.coalesce(1).checkpoint(eager=True) for k, v in small.items()}


def _questions(t: dict[str, DataFrame]) -> DataFrame:
    """``(qid, question, expected, type)`` derived from the data: three
    questions for each year, one for a year without data, and three that name
    no year."""
    first = t["top"].filter("rank = 1").select("year", F.col("mfo_name").alias("leader"))
    base = t["yearly"].join(first, "year", "left")  # one row per year
    last = base.agg(F.max("year").alias("y"), F.max_by("leader", "year").alias("leader"))
    y = F.col("year").cast("string")
    row = lambda text, expected, kind: F.struct(
        text.alias("question"), expected.alias("expected"), F.lit(kind).alias("type"))
    any_text = F.lit("any text")
    by_year = base.select(F.explode(F.array(
        row(F.concat(F.lit("Market NPL ratio of "), y, F.lit("?")), F.col("avg_npl_pct").cast("string"), "numerical"),
        row(F.concat(F.lit("Which firm was biggest in "), y, F.lit("?")), F.col("leader"), "text"),
        row(F.concat(F.lit("Both segments side by side, year "), y, F.lit("?")), any_text, "analytical"),
    )).alias("q"))
    others = last.select(F.explode(F.array(
        row(F.concat(F.lit("Market NPL ratio of "), (F.col("y") + 30).cast("string"), F.lit("?")), any_text, "analytical"),
        row(F.lit("Who tops the ranking?"), F.col("leader"), "text"),
        row(F.lit("How do the segments differ?"), any_text, "analytical"),
        row(F.lit("Give the market overview."), F.lit(TX.SUMMARY_TITLE), "text"),
    )).alias("q"))
    return by_year.union(others).select(F.col("q.question").alias("qid"), "q.*")


def _summary_qa(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    docs = TX.summary_lines(t["yearly"]).select("id", "text")
    return R.answer_questions(_questions(t).select("qid", "question"), docs, k=2)


def _hybrid_on(t: dict[str, DataFrame], questions: DataFrame) -> DataFrame:
    return R.hybrid_answers(questions, t["yearly"], t["segments"], t["top"], t["sources"],
                            TX.summary_lines(t["yearly"]).select("id", "text"))


def _all_questions(spark: SparkSession, sf: str, t: dict[str, DataFrame]) -> DataFrame:
    """The derived questions and every user turn of the conversations."""
    return _questions(t).select("qid", "question").unionByName(_user_turns(spark, sf))


def _hybrid(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    return _hybrid_on(t, _all_questions(spark, sf, t))


def _answer_sources(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    facts = R.structured_facts(t["yearly"], t["segments"], t["top"])
    return R.answer_sources(R.route_questions(_all_questions(spark, sf, t), facts), t["sources"])


def _eval_scores(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    qs = _questions(t)
    answers = _hybrid_on(t, qs.select("qid", "question")).select("qid", "question", "answer")
    return EV.accuracy(EV.score(EV.attach_expected(answers, qs.select("qid", "expected", "type"))))


def _repeated_qa(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn asked twice under different ids."""
    turns = _user_turns(spark, sf)
    again = turns.withColumn("qid", F.concat(F.lit("again:"), F.col("qid")))
    return R.answer_questions(turns.unionByName(again), _chunk_docs(spark, sf), k=2)


# The rules of routing, written out for SQL: words are lower-case runs of
# letters and digits, every table with enough weight is asked for.


def _kinds_sql(words: str) -> str:
    def points(term: str, weight: int) -> str:
        hit = (f"len(list_filter({words}, lambda w: starts_with(w, '{term[:-1]}'))) > 0" if term.endswith("*")
               else f"list_contains({words}, '{term}')")
        return f"CASE WHEN {hit} THEN {weight} ELSE 0 END"

    asked = ", ".join(f"CASE WHEN {' + '.join(points(*x) for x in terms.items())} >= {RT.ENOUGH} THEN '{kind}' END"
                      for kind, terms in sorted(RT.DESCRIPTIONS.items()))
    return f"list_filter([{asked}], lambda k: k IS NOT NULL)"


_YEARLY_CTE = f"yearly AS (SELECT year, {S.MARKET_AGGS} FROM marked GROUP BY year)"
_FACTS_CTE = f"""{_YEARLY_CTE},
  seg AS (SELECT year, {_SEG} AS segment, {S.SEGMENT_AGGS} FROM marked GROUP BY year, is_leader),
  top3 AS ({_TOP_SQL.format(metric="assets", n=3, extra="")}),
  facts AS (
    SELECT 'yearly' AS kind, year, 0 AS no, CAST(year AS VARCHAR) || ': ' || CAST(mfo_count AS VARCHAR)
           || ' MFOs, Assets ' || printf('%.1f', total_assets / 1e9) || 'B KZT, NPL '
           || coalesce(printf('%.2f', avg_npl_pct), 'nan') || '%' AS line FROM yearly
    UNION ALL SELECT 'segment', year, CASE WHEN segment = 'leaders' THEN 0 ELSE 1 END,
           CAST(year AS VARCHAR) || ' ' || segment || ': ' || CAST(mfo_count AS VARCHAR) || ' firms, Assets '
           || printf('%.1f', total_assets / 1e9) || 'B KZT, NPL ' || coalesce(printf('%.2f', avg_npl_pct), 'nan') || '%' FROM seg
    UNION ALL SELECT 'ranking', year, rank,
           CAST(year AS VARCHAR) || ' no. ' || CAST(rank AS VARCHAR) || ': ' || mfo_name || ', Assets '
           || printf('%.1f', assets / 1e9) || 'B KZT, NPL ' || coalesce(printf('%.2f', npl_pct), 'nan') || '%' FROM top3),
  lead AS (SELECT year, mfo_name FROM top3 WHERE rank = 1),
  final AS (SELECT max(year) AS y, arg_max(mfo_name, year) AS leader FROM lead)"""
_QUESTIONS_SQL = f"""
    SELECT 'Market NPL ratio of ' || CAST(year AS VARCHAR) || '?' AS question,
           CAST(avg_npl_pct AS VARCHAR) AS expected, 'numerical' AS type FROM yearly
    UNION ALL SELECT 'Which firm was biggest in ' || CAST(y.year AS VARCHAR) || '?', l.mfo_name, 'text'
      FROM yearly y LEFT JOIN lead l ON y.year = l.year
    UNION ALL SELECT 'Both segments side by side, year ' || CAST(year AS VARCHAR) || '?', 'any text', 'analytical' FROM yearly
    UNION ALL SELECT 'Market NPL ratio of ' || CAST(y + 30 AS VARCHAR) || '?', 'any text', 'analytical' FROM final
    UNION ALL SELECT 'Who tops the ranking?', leader, 'text' FROM final
    UNION ALL SELECT 'How do the segments differ?', 'any text', 'analytical' FROM final
    UNION ALL SELECT 'Give the market overview.', {_quoted(TX.SUMMARY_TITLE)}, 'text' FROM final"""
_YEAR_QS_SQL = "SELECT question AS qid, question FROM derived"
_YEAR_RE = r"((?:19|20)\d{2})"


def _routing_cte(asked: str) -> str:
    words = _TOK.format(t="question")
    return f"""{_FACTS_CTE},
  derived AS ({_QUESTIONS_SQL}),
  qs0 AS ({asked}),
  worded AS (SELECT qid, question, {words} AS words FROM qs0),
  kinded AS (SELECT qid, regexp_extract_all(question, '{_YEAR_RE}', 1) AS ys, {_kinds_sql("words")} AS ks FROM worded),
  kinds AS (SELECT qid, ys, unnest(CASE WHEN len(ks) = 0 THEN ['yearly'] ELSE ks END) AS kind FROM kinded),
  named AS (SELECT DISTINCT qid, kind, CAST(unnest(ys) AS INTEGER) AS year FROM kinds),
  routed AS (SELECT n.* FROM named n WHERE EXISTS (SELECT 1 FROM facts f WHERE f.kind = n.kind AND f.year = n.year)
             UNION ALL SELECT qid, kind, (SELECT max(year) FROM facts f WHERE f.kind = k.kind) FROM kinds k
             WHERE len(ys) = 0 AND kind <> 'yearly'),
  said AS (SELECT qid, array_to_string(list_sort(list_distinct(list(r.kind))), '+') AS kind,
                  string_agg(line, {_NL2} ORDER BY f.year, f.kind, f.no) AS facts
           FROM routed r JOIN facts f ON r.kind = f.kind AND r.year = f.year GROUP BY qid),
  per_file AS (SELECT year, file, count(*) AS n_records FROM marked GROUP BY year, file),
  used AS (SELECT qid, file, CAST(sum(n_records) AS BIGINT) AS n_records
           FROM (SELECT DISTINCT qid, year FROM routed) JOIN per_file USING (year) GROUP BY qid, file),
  n_used AS (SELECT qid, count(*) AS n_sources FROM used GROUP BY qid)"""


_ALL_QS = _YEAR_QS_SQL + " UNION ALL " + _USER_TURNS_SQL


def _hybrid_sql(asked: str) -> str:
    return f"""WITH {_routing_cte(asked)},
  near AS ({_qa_sql("docs AS (" + _SUMMARY_SQL + ")", "SELECT * FROM qs0", 2)}),
  merged AS (SELECT near.qid, near.question, coalesce(said.kind, 'semantic') AS route,
      concat_ws({_NL2}, said.facts, NULLIF(near.context, '')) AS context, coalesce(n_sources, 0) AS n_sources
      FROM near LEFT JOIN said USING (qid) LEFT JOIN n_used USING (qid))
  SELECT *, 'Context:' || chr(10) || context AS answer FROM merged"""


_NUMS = r"regexp_extract_all(coalesce(answer, ''), '-?\d+(?:[.,]\d+)?')"
_EVAL_SQL = f"""WITH h AS ({_hybrid_sql(_YEAR_QS_SQL)}), {_FACTS_CTE}, derived AS ({_QUESTIONS_SQL}),
  rec AS (SELECT h.question, h.answer, e.expected, e.type FROM h LEFT JOIN derived e ON h.qid = e.question),
  scored AS (SELECT type, coalesce(CASE type
      WHEN 'numerical' THEN list_bool_or(list_transform({_NUMS},
          lambda s: abs(TRY_CAST(replace(s, ',', '.') AS DOUBLE)
                        - TRY_CAST(replace(expected, ',', '.') AS DOUBLE)) <= 0.01))
      WHEN 'text' THEN contains(lower(coalesce(answer, '')), lower(expected))
      WHEN 'analytical' THEN length(regexp_replace(coalesce(answer, ''), '{S.STRIP_RE}', '', 'g')) > 0
      END, false) AS passed FROM rec)
  SELECT CASE WHEN grouping(type) = 1 THEN 'all' ELSE type END AS type,
         count(*) AS n_tests, count_if(passed) AS n_passed, count_if(passed) / count(*) AS accuracy
  FROM scored GROUP BY ROLLUP (type)"""
register("summary_qa", lambda sp, sf: _summary_qa(sp, sf).select("qid", "question", "context", "answer"),
         S.rounded(f"WITH {_FACTS_CTE}, derived AS ({_QUESTIONS_SQL}) SELECT qid, question, context, answer FROM ("
                   + _qa_sql("docs AS (" + _SUMMARY_SQL + ")", _YEAR_QS_SQL, 2) + ")"),
         ops="R7 R10 R12 over summary lines")
register("hybrid_answers", _hybrid, S.rounded(_hybrid_sql(_ALL_QS)), ops="R13 R14")
register("answer_sources", _answer_sources,
         S.rounded(f"WITH {_routing_cte(_ALL_QS)} SELECT qid, file, n_records FROM used"), ops="R14")
register("eval_scores", _eval_scores, S.rounded(_EVAL_SQL, ratio=("accuracy",)), ratio=("accuracy",),
         ops="R16 J5")
_TWICE = f"{_USER_TURNS_SQL} UNION ALL SELECT 'again:' || qid, question FROM ({_USER_TURNS_SQL})"
register("repeated_qa", lambda sp, sf: _repeated_qa(sp, sf).select("qid", "question", "context", "answer"),
         "SELECT qid, question, context, answer FROM (" + _qa_sql(_CHUNK_DOCS_CTE, _TWICE, 2) + ")",
         ops="R15 S10 J5")

# --- 11. registry views: preview, structured query (A6, P23, P24) -----------------

from periodix.plans import results as RS  # noqa: E402


def _results(spark: SparkSession, sf: str, *names: str) -> dict[str, DataFrame]:
    prepared = RS.prepare(filings(spark, sf), persist=False)
    return RS.compute_all(prepared, names=names)


register(
    "preview",
    lambda sp, sf: RS.preview(_results(sp, sf), "raw").select("mfo_name", "quarter", "year", "assets",
                                                              "npl_pct", "is_leader"),
    S.rounded("""SELECT mfo_name, quarter, year, assets, npl_pct, is_leader FROM marked
        ORDER BY quarter, mfo_name, file, no LIMIT 100""", money=("assets",), ratio=("npl_pct",)),
    money=("assets",), ratio=("npl_pct",), ops="P23 T5",
)
register(
    "structured_query",
    lambda sp, sf: RS.structured_query({"yearly_market": _plan("market of 2000", sp, sf, lambda: agg.yearly_market(
        metrics.enrich_metrics(panel.filings_panel(sp, sf, 2000))))}, "yearly_market", year=2000),
    S.rounded(f"SELECT year, {S.MARKET_AGGS} FROM marked WHERE year = 2000 GROUP BY year",
              money=MARKET_MONEY, ratio=("avg_npl_pct",)),
    money=MARKET_MONEY, ratio=("avg_npl_pct",), ops="P24 P18",
)

# --- 12. semantic search through the encoder hook (R4, R5, R7) ---------------------

from periodix.operators import encoding as EN  # noqa: E402


def _semantic_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = EN.embed(_chunk_docs(spark, sf), "text", "embedding")
    qs = EN.embed(read_table(spark, sf, "benchmark", "item_id", "text"), "text", "vec")
    return R.cosine_topk(docs, qs, k=3, doc_id="id", doc_vec="embedding",
                         query_id="item_id", query_vec="vec")


def _hashed_vectors_sql(name: str, source: str, dim: int = EN.DEFAULT_DIM) -> str:
    """``{name}(id, v)``: the default encoder's unit vectors, relationally."""
    return f"""{name}_h AS (
    SELECT id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h
    FROM (SELECT id, unnest({_TOK.format(t='text')}) AS t FROM {source})),
  {name}_c AS (SELECT id, h % {dim} AS b, sum(CASE WHEN h < 2147483648 THEN 1.0 ELSE -1.0 END) AS c
               FROM {name}_h GROUP BY ALL),
  {name}_r AS (SELECT x.id, list(coalesce(c.c, 0.0) ORDER BY r.b) AS v
               FROM {source} x CROSS JOIN (SELECT range AS b FROM range({dim})) r
               LEFT JOIN {name}_c c ON c.id = x.id AND c.b = r.b GROUP BY x.id),
  {name} AS (SELECT id, list_transform(v, lambda x: x / n) AS v
             FROM (SELECT id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM {name}_r)
             WHERE n > 0)"""


register(
    "semantic_search", _semantic_search,
    S.rounded(f"""WITH {_CHUNK_DOCS_CTE},
  items AS (SELECT item_id AS id, text FROM benchmark),
  {_hashed_vectors_sql("dv", "docs")},
  {_hashed_vectors_sql("qv", "items")},
  s AS (SELECT q.id AS qid, d.id AS doc_id, list_cosine_similarity(q.v, d.v) AS similarity
        FROM qv q CROSS JOIN dv d)
  SELECT qid, CAST(rank AS INTEGER) AS rank, doc_id, similarity FROM (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, doc_id) AS rank FROM s)
  WHERE rank <= 3""", ratio=("similarity",), panel=False),
    ratio=("similarity",), ops="R4 R5 R7",
)

# --- 13. workbooks written and read back (S1-S5) ------------------------------------

from periodix.sources import workbooks as WB  # noqa: E402


def _workbook_read(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    from periodix.session import shared_folder
    from periodix.sources.xlsx import read_filings

    folder = shared_folder(spark, "workbooks")
    WB.write_workbooks(panel.filings_parsed(spark, sf), folder).write.format("noop").mode("overwrite").save()
    return read_filings(spark, folder)


_WB_FILE = f"regexp_replace(file, '[.]xlsx$', '_') || printf('%04d', CAST(no AS INTEGER) // {WB.FIRMS}) || '.xlsx'"
register(
    "workbook_ingest", lambda sp, sf: _workbook_read(sp, sf)[0],
    S.rounded(f"""SELECT * REPLACE ({_SHIFTED} || substr(quarter, 5) AS quarter, CAST(year + 20 AS INTEGER) AS year,
        {_WB_FILE} AS file) FROM filings""", money=MONEY_ROW[:6]),
    money=MONEY_ROW[:6], ops="S1 S2 S3 S5",
)
register(
    "workbook_errors",
    lambda sp, sf: _workbook_read(sp, sf)[1].withColumn("error", F.substring_index("error", ":", 1)),
    S.rounded(f"""WITH f AS (SELECT {_WB_FILE} AS file, '01.' || substr(quarter, 6, 2) || '.' || {_SHIFTED} AS sheet FROM parsed),
        h AS (SELECT file, min(sheet) AS sheet FROM f WHERE file LIKE '%!_h1!_0000.xlsx' ESCAPE '!' GROUP BY file)
        SELECT '~$' || file AS file, CAST(NULL AS VARCHAR) AS sheet, 'unreadable workbook' AS error FROM h
        UNION ALL SELECT 'cut_' || file, NULL, 'unreadable workbook' FROM h
        UNION ALL SELECT 'torn_' || file, sheet, 'unreadable sheet' FROM h"""),
    ops="S1 S4",
)

# --- 14. mergeable counts, stored results, vector collection (A4, S6, S8) --------------

from periodix.plans import store as ST  # noqa: E402


def _sketched_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Firms per year and of all years: the exact count, and whether the one
    from the stored quarterly sketches is within its stated error."""
    from periodix.session import shared_folder

    e = enriched(spark, sf)
    folder = shared_folder(spark, "sketches")
    agg.entity_sketches(e).write.parquet(folder)
    sketches = spark.read.parquet(folder)
    every = lambda df: df.withColumn("year", F.lit(None).cast("int")).select("year", "mfo_count")
    near = agg.sketch_counts(sketches, "year").unionByName(every(agg.sketch_counts(sketches)))
    count = F.countDistinct("mfo_name").alias("mfo_count")
    exact = e.groupBy("year").agg(count).unionByName(every(e.agg(count))).withColumnRenamed("year", "_year")
    near = near.withColumnRenamed("mfo_count", "_near")
    off = F.abs(F.col("_near") - F.col("mfo_count"))
    return exact.join(near, F.col("_year").eqNullSafe(F.col("year"))).select(
        "year", "mfo_count", (off <= F.ceil(F.col("mfo_count") * agg.SKETCH_ERROR)).alias("within_error"))


register(
    "sketched_counts", _sketched_counts,
    S.rounded("SELECT year, count(DISTINCT mfo_name) AS mfo_count, true AS within_error FROM marked GROUP BY ROLLUP (year)"),
    ops="A4 (sketches)",
)


def publish_results(spark: SparkSession, sf: str, root: str) -> None:
    """The yearly market table and the ranking, as the newest version of a store."""
    from pyspark import StorageLevel

    m = marked(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        ST.publish({"yearly_market": agg.yearly_market(m), "top_mfos": rankings.top_n(m, n=10)}, root)
    finally:
        m.unpersist()


def _stored_query(spark: SparkSession, sf: str) -> DataFrame:
    from periodix.session import shared_folder

    root = shared_folder(spark, "results")
    publish_results(spark, sf, root)
    return ST.Store(spark, root).query("yearly_market", year=2000)


register(
    "stored_query", _stored_query,
    S.rounded(f"SELECT year, {S.MARKET_AGGS} FROM marked WHERE year = 2000 GROUP BY year",
              money=MARKET_MONEY, ratio=("avg_npl_pct",)),
    money=MARKET_MONEY, ratio=("avg_npl_pct",), ops="S6 P24 P18",
)


def _collection_search(spark: SparkSession, sf: str) -> DataFrame:
    """A collection written, replaced, left alone by an empty write, read back
    and searched; the winners' texts come by a join on the collection's buckets."""
    from periodix.session import shared_folder
    from periodix.sources.sinks import read_vector_collection, write_vector_collection

    emb = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    docs = emb.select(
        F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("text"),
        "embedding", F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    path = shared_folder(spark, "collection")
    write_vector_collection(docs.filter("metadata['label'] < '5'"), path)
    write_vector_collection(docs, path)
    write_vector_collection(docs.filter("id IS NULL"), path)
    stored = read_vector_collection(spark, path)
    asked = emb.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vec"))
    hits = R.cosine_topk(stored, asked, k=3, doc_id="id").withColumnRenamed("doc_id", "id")
    return hits.join(stored.select("id", "text"), "id").select(
        "qid", F.col("rank").cast("int").alias("rank"), "id", "text", "similarity")


register(
    "collection_search", _collection_search,
    S.rounded("""SELECT qid, CAST(rank AS INTEGER) AS rank, id, 'vector ' || id AS text, similarity FROM (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, id) AS rank FROM (
          SELECT q.vec_id AS qid, CAST(d.vec_id AS VARCHAR) AS id,
                 list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(d.embedding AS DOUBLE[])) AS similarity
          FROM embeddings q CROSS JOIN embeddings d WHERE q.vec_id % 20 = 0)) WHERE rank <= 3""",
              ratio=("similarity",), panel=False),
    ratio=("similarity",), ops="S8 R5 R7",
)

# --- 15. question and record files written and read back (S9, S10) --------------------


def _question_files(spark: SparkSession, sf: str) -> DataFrame:
    """Every user turn written as a line and read back: times it was asked, by ids."""
    from periodix.session import shared_folder
    from periodix.sources.sinks import read_questions

    folder = shared_folder(spark, "questions")
    _user_turns(spark, sf).select(F.translate("question", "\n", " ").alias("value")).write.text(folder)
    return read_questions(spark, folder).groupBy("question").agg(F.countDistinct("qid").alias("n_asked"))


register(
    "question_files", _question_files,
    """SELECT replace(text, chr(10), ' ') AS question, count(*) AS n_asked FROM conversations
       WHERE role = 'user' AND trim(replace(text, chr(10), ' ')) <> '' GROUP BY 1""",
    ops="S10",
)


def _record_files(spark: SparkSession, sf: str) -> DataFrame:
    """Each answered user turn as an evaluation record, written, read back and
    scored; a file cut in the middle of a document is told apart."""
    from periodix.session import shared_folder

    conv = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    asked = conv.filter("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    records = conv.filter("role = 'assistant'").join(asked, ["conv_id", "turn"]).select(
        F.concat(F.lit("run "), F.col("conv_id") % 4).alias("timestamp"), "question", F.col("text").alias("answer"),
        F.substring_index("question", " ", 1).alias("expected"),
        F.when(F.col("conv_id") % 3 == 0, "analytical").otherwise("text").alias("type"))
    folder = shared_folder(spark, "records")
    EV.write_evaluation(records, folder)
    cut = records.agg(F.concat(F.lit('{"total_tests": 1, "tests": [{"question": "'), F.min("timestamp")).alias("value"))
    cut.write.mode("append").text(folder)
    read, faulty = EV.parse_evaluation(spark, folder)
    counts = EV.score(read).groupBy("timestamp", "type").agg(
        F.count(F.lit(1)).alias("n_tests"), F.count_if("passed").alias("n_passed"))
    return counts.unionByName(faulty.agg(
        F.lit(None).cast("string").alias("timestamp"), F.lit("faulty").alias("type"),
        F.count(F.lit(1)).alias("n_tests"), F.lit(0).cast("long").alias("n_passed")))


register(
    "record_files", _record_files,
    """SELECT 'run ' || CAST(a.conv_id % 4 AS VARCHAR) AS timestamp,
              CASE WHEN a.conv_id % 3 = 0 THEN 'analytical' ELSE 'text' END AS type, count(*) AS n_tests,
              count_if(CASE WHEN a.conv_id % 3 = 0 THEN trim(a.text) <> ''
                       ELSE contains(lower(a.text), lower(split_part(q.text, ' ', 1))) END) AS n_passed
       FROM conversations a JOIN conversations q ON a.conv_id = q.conv_id AND a.turn = q.turn + 1
       WHERE a.role = 'assistant' AND q.role = 'user' GROUP BY 1, 2
       UNION ALL SELECT NULL, 'faulty', 1, 0""",
    ops="S9 R16",
)
