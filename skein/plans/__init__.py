"""Registered queries, views and the page store."""
