"""Registered queries: each operator applied to a table, with the SQL that must give the same rows."""
