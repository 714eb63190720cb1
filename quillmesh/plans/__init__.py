"""Queries over the driver tables, each beside the SQL it must agree with."""
