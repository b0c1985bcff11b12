"""Queries over the given tables, one module per family."""

from importlib import import_module

FAMILIES = ("metrics", "ticks", "scalars", "catalog", "population", "ranking", "gate", "choice", "feedback",
            "trajectory", "network", "storage", "streams")


def load_all() -> None:
    for name in FAMILIES:
        try:
            import_module(f"tripwise.plans.{name}_queries")
        except ModuleNotFoundError as e:
            if f"{name}_queries" not in str(e):
                raise
