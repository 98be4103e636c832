"""Queries over the given tables; load() registers all of them."""

from __future__ import annotations

from importlib import import_module
from types import ModuleType

MODULES = ("temporal", "prices", "metrics", "records", "factors", "master", "sources", "checks", "market", "rest", "kept", "harness")


def load() -> ModuleType:
    for name in MODULES:
        import_module(f"tidemark.plans.{name}")
    return import_module("tidemark.plans.registry")
