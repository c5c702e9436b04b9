"""Readers (workbook directories, parquet tables, panel adapter) and sinks."""
