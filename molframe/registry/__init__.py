"""Registered queries, by the binding they run on."""

from __future__ import annotations

import importlib
import pkgutil

from molframe.registry.base import QUERIES, Entry


def load() -> dict[str, Entry]:
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    return dict(QUERIES)
