"""Registered queries and training plans."""

from __future__ import annotations

import importlib.util

# The modules that register queries; the training and streaming ones come after the batch ones.
_MODULES = (
    "airlens.plans.queries", "airlens.plans.file_queries", "airlens.plans.boot_queries", "airlens.plans.training_queries", "airlens.streaming.queries",
)


def _load():
    from airlens.plans import registry

    for name in _MODULES:
        if importlib.util.find_spec(name) is not None:
            importlib.import_module(name)
    return registry


def all_queries():
    return dict(_load().QUERIES)


def all_oracles():
    return dict(_load().ORACLES)
