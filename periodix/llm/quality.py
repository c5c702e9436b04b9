"""Operator 4 [native]: quality rules with cross-document line frequency.

Two parts, both DataFrame functions only:

* ``text_stats``: per-document counts (words, symbols, repeated lines, words
  in repeated 5-word windows), computed inside the row with array functions,
  so no text is shuffled.
* ``line_verdicts``: every line with a word is normalised (lower case, white
  space folded) and hashed; distinct documents are counted per (host, line).
  A line that more than ``max(min_docs, share x documents of the host)``
  documents of its host carry is boilerplate and is removed from all of them
  but the earliest (smallest id), so that content which is merely repeated
  survives once.  A document of which fewer than ``min_words`` words or less
  than ``min_left`` percent of its words remain is depleted.

Equal texts of one host count as one document: copies are the business of
the near-duplicate join, not evidence of boilerplate.  Both counts are
partial aggregates before each shuffle, so a line that a third of all
documents carry is one row per task; the look-up of frequent lines is an
equi-join whose skew AQE splits.

Defined results: a null or empty text has no words and fails the base rule;
a null host is a host of its own; a null id is a document of its own, sorts
last and never is the earliest when others exist; repeated rows are one
document, each row getting the same verdict; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from periodix.llm.common import SEPARATOR_CLASS, SEPARATORS, table, words_of

WINDOW = 5            # words of a repeated window
MIN_WORDS = 10        # base rule, and least words left by the line rule
MAX_REPEAT = 20       # percent of words in repeated windows
SYMBOLS = "#*$%&|<>"
LINE_MIN_DOCS = 10    # a line in so few documents of a host is never removed
LINE_SHARE = 5        # percent of the host's documents a line may be in
MIN_LEFT = 50         # percent of its words that a document must keep


def text_stats(df: DataFrame, text: Column) -> DataFrame:
    """``df`` plus ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed``."""
    chars = F.coalesce(text, F.lit(""))
    strip = lambda c, what: F.length(c) - F.length(F.translate(c, what, ""))
    lines = F.filter(F.split(chars, "\n"), lambda x: F.translate(x, SEPARATORS, "") != "")
    df = df.withColumn("_h", F.transform(words_of(text), lambda w: F.xxhash64(w)))
    df = df.withColumn("_lines", lines)
    # one 64-bit hash for each window; distinct windows tell whether any repeats
    df = df.withColumn("_g", F.expr(
        f"CASE WHEN size(_h) > {WINDOW} THEN transform(sequence(0, size(_h) - {WINDOW}), "
        f"i -> xxhash64({', '.join(f'_h[i + {k}]' for k in range(WINDOW))})) ELSE array() END"))
    # only documents with a repeated window are sorted: equal windows then are neighbours
    df = df.withColumn("_s", F.expr(
        "CASE WHEN size(array_distinct(_g)) < size(_g) "
        "THEN array_sort(transform(_g, (x, i) -> named_struct('x', x, 'i', i))) "
        "ELSE cast(array() as array<struct<x: bigint, i: int>>) END"))
    df = df.withColumn("_p", F.expr(
        "array_sort(transform(filter(_s, (e, k) -> (k > 0 AND _s[k - 1].x = e.x) OR "
        "(k < size(_s) - 1 AND _s[k + 1].x = e.x)), e -> e.i))"))
    covered = F.expr(
        "aggregate(_p, named_struct('c', 0L, 'at', -1000), "
        f"(a, i) -> named_struct('c', a.c + least({WINDOW}, i - a.at), 'at', i), a -> a.c)")
    return df.select(
        *[c for c in df.columns if c not in ("_h", "_lines", "_g", "_s", "_p")],
        F.size("_h").cast("long").alias("n_words"),
        F.length(F.translate(chars, SEPARATORS, "")).cast("long").alias("word_chars"),
        strip(chars, SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        # a filter on the verdict must not move below this projection: it would
        # be unfolded into the array functions and computed once for each element
        F.monotonically_increasing_id().alias("_row"),
    ).withColumn("base_failed", (F.col("_row") >= 0) & (
        (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words")))).drop("_row")


def _keyed(docs: DataFrame) -> DataFrame:
    """Slim rows with hashes of host and content; (id, host, content) is a document."""
    return docs.select(docs["doc_id"].alias("_id"), F.xxhash64(docs["source"]).alias("_host"),
                       F.xxhash64(docs["text"]).alias("_content"), docs["text"].alias("_text"))


def removed_words(docs: DataFrame, min_docs: int = LINE_MIN_DOCS, share: int = LINE_SHARE) -> DataFrame:
    """``_id, _host, _content, _lost_lines, _lost_words`` of documents that lose lines."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(c, SEPARATOR_CLASS + "+", " ")))
    keyed = _keyed(docs)
    lines = (keyed.select("_id", "_host", "_content", F.posexplode(F.split("_text", "\n")).alias("_at", "_raw"))
             .withColumn("_line", fold(F.col("_raw"))).where("_line <> ''")
             .select("_id", "_host", "_content", "_at", F.xxhash64("_line").alias("_line"),
                     F.size(words_of(F.col("_raw"))).alias("_n")))
    last = F.expr("9223372036854775807L")
    contents = lines.groupBy("_host", "_line", "_content").agg(F.min(F.coalesce("_id", last)).alias("_first"))
    hosts = (keyed.groupBy("_host", "_content").agg(F.lit(1).alias("_one"))
             .groupBy("_host").agg(F.count("*").alias("_docs")))
    frequent = (contents.groupBy("_host", "_line")
                .agg(F.count("*").alias("_in"), F.min(F.struct("_first", "_content")).alias("_keep"))
                .where(F.col("_in") > min_docs)
                .join(hosts, "_host")
                .where(100 * F.col("_in") > share * F.col("_docs"))
                .select("_host", "_line", F.col("_keep._content").alias("_kept_in")))
    return (lines.join(frequent, ["_host", "_line"]).where("_content <> _kept_in")
            .dropDuplicates(["_id", "_host", "_content", "_at"])  # repeated rows
            .groupBy("_id", "_host", "_content")
            .agg(F.count("*").alias("_lost_lines"), F.sum("_n").alias("_lost_words")))


def line_verdicts(docs: DataFrame, min_docs: int = LINE_MIN_DOCS, share: int = LINE_SHARE,
                  min_left: int = MIN_LEFT, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` -> every input column with the
    counts, ``n_removed_lines``, ``n_removed_words``, ``base_failed`` and
    ``kept`` in one struct column ``quality``."""
    stats = text_stats(docs.select(
        F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), docs["doc_id"].alias("_id"),
        F.xxhash64(docs["source"]).alias("_host"), F.xxhash64(docs["text"]).alias("_content"),
        docs["text"].alias("_text")), F.col("_text")).drop("_text")
    lost = removed_words(docs, min_docs, share)
    key = [stats["_id"].eqNullSafe(lost["_id"]), stats["_host"] == lost["_host"],
           stats["_content"] == lost["_content"]]
    gone = F.coalesce(lost["_lost_words"], F.lit(0))
    left = F.col("n_words") - gone
    kept = ~F.col("base_failed") & (left >= min_words) & (100 * left >= min_left * F.col("n_words"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return stats.join(lost, key, "left").select(
        "_doc.*", F.struct(*names, kept.alias("kept"),
                           F.coalesce(lost["_lost_lines"], F.lit(0)).alias("n_removed_lines"),
                           gone.alias("n_removed_words")).alias("quality"))


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "source")
    # the text is needed for its hash and counts only: drop it before the join
    return line_verdicts(docs).select("doc_id", "quality.*")


_SEP = "[\\x20\\x09-\\x0D]"
SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{_SEP}+'), lambda x: x <> '') AS ws,
    length(regexp_replace(text, '{_SEP}', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM d),
win AS (SELECT doc_id, i, list_slice(ws, i, i + {WINDOW - 1}) AS g
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
    FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) x, range({WINDOW}) r(k)
    WHERE n > 1 GROUP BY doc_id),
raw AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (SELECT doc_id, source, text, line, lower(trim(regexp_replace(line, '{_SEP}+', ' ', 'g'))) AS norm,
    len(list_filter(regexp_split_to_array(line, '{_SEP}+'), lambda x: x <> '')) AS n FROM raw),
l AS (SELECT * FROM ln WHERE norm <> ''),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l GROUP BY doc_id),
con AS (SELECT source, norm, text, min(doc_id) AS first FROM l GROUP BY ALL),
hosts AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
freq AS (SELECT source, norm, count(*) AS n, arg_min(text, first) AS kept_in FROM con GROUP BY ALL),
bad AS (SELECT f.* FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source
    WHERE f.n > {LINE_MIN_DOCS} AND 100 * f.n > {LINE_SHARE} * h.docs),
lost AS (SELECT l.doc_id, count(*) AS lines, sum(l.n)::BIGINT AS words FROM l JOIN bad b
    ON l.source IS NOT DISTINCT FROM b.source AND l.norm = b.norm WHERE l.text <> b.kept_in GROUP BY l.doc_id),
s AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(lines, 0)::BIGINT AS n_removed_lines, coalesce(words, 0)::BIGINT AS n_removed_words
    FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN lost USING (doc_id)),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT} * n_words AS base_failed FROM s)
SELECT *, NOT base_failed AND n_words - n_removed_words >= {MIN_WORDS}
    AND 100 * (n_words - n_removed_words) >= {MIN_LEFT} * n_words AS kept FROM b
"""
