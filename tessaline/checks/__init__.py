"""Queries over the sample tables and the SQL that each must equal."""
