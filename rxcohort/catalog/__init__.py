"""Registered queries on the stand-in tables, and SQL that must agree with them."""
