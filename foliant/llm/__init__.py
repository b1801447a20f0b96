"""Operators that prepare text for training language models. Nothing else in the library imports this package."""

from importlib import import_module

_MODULES = ("scans_queries", "lookalikes_queries", "encodings_queries", "splitting_queries", "tokens_queries", "leaks_queries", "quality_queries")


def query_modules() -> list:
    return [import_module(f"foliant.llm.{name}") for name in _MODULES]
