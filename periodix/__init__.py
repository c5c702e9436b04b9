"""periodix -- Spark-native analytics for periodic regulatory filings.

Layers:
  sources/    readers (workbook directories, parquet tables) and sinks
  functions/  column-expression helpers (parsing, ratios, text, vectors)
  operators/  DataFrame -> DataFrame operators (metrics, leaders, aggregates,
              rankings, changes, text chunks, retrieval, evaluation)
  plans/      the named-result registry and the registered query catalog
  streaming/  incremental ingest of newly arriving filings
"""

__version__ = "0.1.0"
