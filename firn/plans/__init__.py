"""Named pipelines and queries."""

from importlib import import_module

MODULES = ["flat", "nested", "text", "bins", "timeline", "tables", "space", "likelihood", "signal"]


def load_all() -> None:
    for name in MODULES:
        import_module(f"firn.plans.{name}")
