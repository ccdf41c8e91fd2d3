"""Registered queries and their oracles."""

from . import control_queries, detail_queries, listing_queries, page_queries

QUERY_SETS = [listing_queries, page_queries, control_queries, detail_queries]
