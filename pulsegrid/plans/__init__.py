"""Registered queries: bindings of operators to tables, with SQL to hold them against."""
