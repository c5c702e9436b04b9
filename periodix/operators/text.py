"""Summary lines, line chunks, contexts, prompts, answers.

All string work is JVM-side (``concat``, ``format_number``, array
higher-order functions); chunking is a per-row array transform followed by
``posexplode`` -- no shuffle and no window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from periodix.functions.columns import BILLION, fmt_fixed, py_strip

# --- fixed values (rendering of the reference's summary and prompt) ----------
SUMMARY_TITLE = "Market Overview"
CONTEXT_SEPARATOR = "\n\n"
ANSWER_PREFIX = "Context:\n"
PROMPT_TEMPLATE = (
    "You are an analyst for the National Bank of Kazakhstan.\n\n"
    "Context:\n{context}\n\n"
    "Question: {question}\n\n"
    "Provide a concise, data-driven answer in 2-3 sentences."
)
# -----------------------------------------------------------------------------


def figures(assets: Column, npl_pct: Column, unit: float = BILLION) -> Column:
    """Assets and NPL as the lines show them (missing NPL prints ``nan``)."""
    return F.concat(F.lit("Assets "), fmt_fixed(assets / F.lit(unit), 1), F.lit("B KZT, NPL "),
                    F.coalesce(fmt_fixed(npl_pct, 2), F.lit("nan")), F.lit("%"))


def summary_line(year: Column, n: Column, assets: Column, npl_pct: Column, unit: float = BILLION) -> Column:
    """One overview line as a column."""
    return F.concat(year.cast("string"), F.lit(": "), n.cast("string"), F.lit(" MFOs, "), figures(assets, npl_pct, unit))


def summary_lines(yearly: DataFrame, unit: float = BILLION) -> DataFrame:
    """R1 + R3: the overview as indexed line documents.

    ``(id, line_no, text, metadata)`` with ``summary_0`` the title line and
    one line per year in year order.  ``yearly`` has one row per year, so the
    line-numbering window runs over a calendar-bounded input.
    """
    lines = yearly.select(
        (F.row_number().over(Window.orderBy("year"))).alias("line_no"),
        summary_line(F.col("year"), F.col("mfo_count"), F.col("total_assets"),
                     F.col("avg_npl_pct"), unit).alias("text"),
    )
    title = yearly.sparkSession.range(1).select(F.lit(0).alias("line_no"), F.lit(SUMMARY_TITLE).alias("text"))
    out = title.unionByName(lines)
    return out.select(
        F.concat(F.lit("summary_"), F.col("line_no").cast("string")).alias("id"),
        F.col("line_no").cast("int").alias("line_no"),
        "text",
        F.create_map(F.lit("type"), F.lit("summary")).alias("metadata"),
    )


def chunk_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: tuple[str, ...] = ()) -> DataFrame:
    """R2 + R3: split on ``\\n``, strip (Python whitespace), drop blanks.

    ``chunk_no`` counts kept lines from 0, so numbering is over non-blank
    lines only.  ``keep`` columns are carried along (e.g. metadata fields).
    """
    parts = F.filter(
        F.transform(F.split(F.col(text_col), "\n", -1), py_strip),
        lambda x: x != "",
    )
    return docs.select(
        F.col(id_col), *keep, F.posexplode(parts).alias("chunk_no", "chunk")
    ).select(id_col, *keep, F.col("chunk_no").cast("int").alias("chunk_no"), F.col("chunk").alias("text"))


def contexts(hits: DataFrame, qid: str = "qid", rank: str = "rank", text: str = "text",
             k: int | None = None) -> DataFrame:
    """Join each question's top hits, best first, with a blank line.

    Hits per question are bounded by the retrieval ``k``.
    """
    h = hits.filter(F.col(rank) <= k) if k else hits
    return h.groupBy(qid).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), F.col(text).alias("t")))),
                        lambda s: s["t"]),
            CONTEXT_SEPARATOR,
        ).alias("context")
    )


def context_answer(context: Column) -> Column:
    """The answer when no language model is configured."""
    return F.concat(F.lit(ANSWER_PREFIX), F.coalesce(context, F.lit("")))


def prompt(question: Column, context: Column, template: str = PROMPT_TEMPLATE) -> Column:
    """The language-model prompt for a question and its context."""
    before_ctx, rest = template.split("{context}", 1)
    between, after = rest.split("{question}", 1)
    return F.concat(F.lit(before_ctx), F.coalesce(context, F.lit("")), F.lit(between), question, F.lit(after))
