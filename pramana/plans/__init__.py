"""Registered queries by family; importing a family registers its queries."""

from . import call_queries, date_queries, document_queries, due_queries, feed_queries, pdf_queries, privacy_queries, result_queries, rule_queries, store_queries, stream_queries, table_queries, text_output_queries, text_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "call_queries", "date_queries", "document_queries", "due_queries", "feed_queries", "pdf_queries", "privacy_queries", "result_queries", "rule_queries", "store_queries", "stream_queries", "table_queries", "text_output_queries", "text_queries"]
