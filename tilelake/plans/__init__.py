"""Registered queries: operators applied to map-shaped views of the tables, each with the SQL that returns its rows."""
