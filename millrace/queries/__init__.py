"""Registered queries: a Spark callable and, where SQL can say the same, a check query in SQL side by side."""

from __future__ import annotations

from importlib import import_module

FAMILIES = (
    "slice", "scans", "routing", "joining", "aggregating", "ordering", "attributes", "texts", "profiling", "synthesis", "rules",
    "scoring", "private", "lineage", "streams", "code", "flows",
)


def collect() -> tuple[dict, dict]:
    """All queries and their check SQL by key."""
    found, checks = {}, {}
    for family in FAMILIES:
        r = import_module(f"millrace.queries.{family}").R
        found.update(r.queries)
        checks.update(r.sql)
    return found, checks
