"""Operators for training-data pipelines, one module per operator.

``queries()`` and ``oracle_sql()`` gather what the modules register.
"""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "media",
    "warc",
    "packing",
    "token_counts",
    "near_dedup",
    "fingerprints",
    "secret_scan",
    "chat_format",
    "language_id",
    "mixing",
    "alignment",
    "turn_repair",
    "top_k",
)


def queries():
    """Every registered query of this subpackage, by name."""
    found = {}
    for name in MODULES:
        found.update(import_module(f"{__name__}.{name}").QUERIES)
    return found


def oracle_sql():
    """DuckDB SQL for the queries that SQL can express."""
    found = {}
    for name in MODULES:
        found.update(getattr(import_module(f"{__name__}.{name}"), "ORACLE_SQL", {}))
    return found
