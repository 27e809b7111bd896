"""All registered queries: name -> (Spark callable, SQL text or None)."""

from __future__ import annotations

from importlib import import_module

MODULES = ("usage", "compaction", "search", "code", "calls", "streams")


def registered() -> dict:
    out: dict = {}
    for module in MODULES:
        for name, entry in import_module(f"corpuscope.queries.{module}").QUERIES.items():
            if name in out:
                raise ValueError(f"query {name} is registered twice")
            out[name] = entry
    return out
