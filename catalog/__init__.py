"""Registered queries and, where SQL can express them, the SQL they are compared with."""

from importlib import import_module

MODULES = [
    "sessions_and_measures",
    "minute_families",
    "daily_families",
    "labels_and_folds",
    "evaluation",
    "source_checks",
    "heads",
    "boosting",
    "full_job",
    "joined_families",
]


def queries():
    merged = {}
    for name in MODULES:
        merged.update(import_module(f"catalog.{name}").QUERIES)
    return merged


def oracle_sql():
    merged = {}
    for name in MODULES:
        merged.update(import_module(f"catalog.{name}").ORACLE)
    return merged
