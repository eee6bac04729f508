"""Query plans, one module per family; ``load`` imports them all and returns the registry."""

from importlib import import_module

FAMILIES = ("statistics", "ordered", "volumes", "points", "detection", "cohorts", "splitting", "measures", "grids", "tubes")


def load():
    for family in FAMILIES:
        import_module(f"voxarbor.plans.{family}")
    return import_module("voxarbor.plans.registry")
