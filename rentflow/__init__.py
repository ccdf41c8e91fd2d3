"""Listing-monitor analytics on Spark: tables in, tables out."""
