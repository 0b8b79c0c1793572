"""Scans and sinks: driver parquet tables, TEI XML, labelled TSV, metrics trees."""
