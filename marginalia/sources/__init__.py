"""Scans and sinks: text corpora, name lists, keyed tables, dated reports."""
