"""Readers and writers of tables in files, and changes of stored tables."""

from lexforge.sources.files import datasets, read_csv, read_documents, read_json_lines, records, search_response, write_report
from lexforge.sources.stored import BucketTable, Sink, dual_write, insert_if_absent, replace, stream_to, without_rows

__all__ = ["BucketTable", "Sink", "datasets", "dual_write", "insert_if_absent", "read_csv", "read_documents", "read_json_lines", "records", "replace", "search_response", "stream_to", "without_rows", "write_report"]
