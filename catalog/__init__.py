"""Registered queries with their reference SQL; importing this package fills ``base.REGISTRY``."""

import importlib

from .base import REGISTRY

PARTS = ("sources_cleaning", "windows", "signals", "profiling", "joins", "runs", "detectors", "evaluation",
         "scalars", "splits_models", "presets", "streams")

for _part in PARTS:
    try:
        importlib.import_module(f"{__name__}.{_part}")
    except ModuleNotFoundError as missing:
        if missing.name != f"{__name__}.{_part}":
            raise

__all__ = ["REGISTRY"]
