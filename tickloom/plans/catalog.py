"""Import every module that registers queries."""

from __future__ import annotations

import importlib
import pkgutil

import tickloom.plans as package


def load() -> None:
    for info in pkgutil.iter_modules(package.__path__):
        if info.name.startswith("queries_"):
            importlib.import_module(f"tickloom.plans.{info.name}")
