"""All queries by name, with their SQL twins."""

from __future__ import annotations

from importlib import import_module

SECTIONS = ["identity", "feed", "times", "text", "events", "pages", "rules", "streams"]


def all_queries() -> dict:
    out = {}
    for name in SECTIONS:
        out |= import_module(f"feedspark.plans.{name}").QUERIES
    return out
