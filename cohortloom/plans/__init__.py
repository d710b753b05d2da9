"""Registered queries: each applies library operators to the domain views and states its oracle in SQL."""

from __future__ import annotations

import importlib

from cohortloom.registry import QUERIES, Query

MODULES = (
    "scalar_queries",
    "join_queries",
    "profile_queries",
    "window_queries",
    "selection_queries",
    "metric_queries",
    "calibration_queries",
    "fold_queries",
    "preparation_queries",
    "model_queries",
    "neighbor_queries",
    "voxel_queries",
    "volume_queries",
    "source_queries",
    "streaming_queries",
    "hook_queries",
)


def load_all() -> dict[str, Query]:
    """Import every query module once and return the registry."""
    for module in MODULES:
        name = f"cohortloom.plans.{module}"
        try:
            importlib.import_module(name)
        except ModuleNotFoundError as error:
            if error.name != name:
                raise
    return QUERIES
