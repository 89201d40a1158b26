"""Queries: operators applied to the driver's tables, with the DuckDB SQL of each."""
