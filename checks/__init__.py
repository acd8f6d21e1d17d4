"""Registered queries with the SQL each must agree with."""
