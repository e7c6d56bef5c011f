"""Fixtures derived from the driver tables, composite jobs and the query catalog."""
