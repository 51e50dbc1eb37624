"""Queries: test tables bound to operators, one module per operator family."""

import importlib
import pkgutil

from millrace.plans.registry import ORACLES, QUERIES


def load_all():
    """Import every plan module so that it registers its queries."""
    for info in pkgutil.iter_modules(__path__):
        if info.name != "registry":
            importlib.import_module(f"{__name__}.{info.name}")
    return QUERIES, ORACLES
