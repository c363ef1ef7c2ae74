"""Registered queries, by area."""

from importlib import import_module

AREAS = ["extraction", "corpus", "similarity", "classification", "templates", "graph", "lifecycle"]


def load_all() -> None:
    for area in AREAS:
        import_module(f"clauseloom.plans.{area}")
