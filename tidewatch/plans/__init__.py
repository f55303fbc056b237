"""Registered queries: each module binds operators to the test tables and states oracle SQL."""
from importlib import import_module
from importlib.util import find_spec

MODULES = [
    "detection", "scalar", "hunting", "clustering", "graphs", "enrichment", "reporting",
    "scoring", "retrieval", "ingestion", "streams",
]


def load_all():
    for name in MODULES:
        if find_spec(f"tidewatch.plans.{name}"):
            import_module(f"tidewatch.plans.{name}")
    from tidewatch.plans.model import REGISTRY
    return REGISTRY
