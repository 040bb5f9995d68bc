"""Inputs of the queries derived from the star-schema tables, and the queries with the SQL they must agree with."""
