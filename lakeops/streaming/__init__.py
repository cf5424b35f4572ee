"""Streaming forms of the batch operators.

The reference has no streaming operator; the one continuous job it implies is the CSV
shortcut transform, which keeps a table in step with a folder of CSV files.
"""

from lakeops.streaming.csv_ingest import csv_ingest_stream, skip_bad_files  # noqa: F401
