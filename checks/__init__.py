"""Registered queries over the test tables, each with DuckDB SQL that gives the same rows."""
