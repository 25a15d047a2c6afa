"""Bindings, named plans and their reference SQL."""

from __future__ import annotations

import importlib

FAMILIES = (
    "scoring",
    "tuning",
    "labelling",
    "recognition",
    "validation",
    "adaptation",
    "reviews",
    "exchange",
    "streams",
)


def load():
    """Import every plan family and return the registry."""
    for family in FAMILIES:
        importlib.import_module(f"{__name__}.{family}")
    return importlib.import_module(f"{__name__}.registry")
