"""Documentation corpora as Spark DataFrames: API specifications and Markdown trees to numbered texts.

The names below are the library's surface; each is imported when it is first asked for, so that workers which
need one module don't load the others.
"""

from __future__ import annotations

import importlib

_HOMES = {
    "docloom.operators.openref": ("decode", "stats", "document_nodes", "operations"),
    "docloom.operators.markdown": ("merge", "sections", "tokens"),
    "docloom.operators.ir": ("by_id", "by_ids", "has", "last_by_id", "spotlight", "total_examples"),
    "docloom.operators.categorize": ("first_match", "uncategorized"),
    "docloom.plans.universal": ("Options",),
    "docloom.plans.generate": ("Outcome", "many", "one", "source", "tasks"),
    "docloom.sources.config": ("Config", "ConfigError"),
    "docloom.sources.detect": ("Format", "ParserError", "Registry", "detect_format", "parse", "registry", "validate"),
    "docloom.sources.fetch": ("Cache", "FetchError", "download", "resolve"),
    "docloom.sources.sink": ("spec_files", "spec_json", "write_files"),
    "docloom.log": ("logger", "set_level"),
}
_HOME = {name: module for module, names in _HOMES.items() for name in names}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(importlib.import_module(_HOME[name]), name)
