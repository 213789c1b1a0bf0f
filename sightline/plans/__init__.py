"""Registered queries: operators bound to the driver tables, each with its SQL twin."""

from importlib import import_module

FAMILIES = ("scoring", "coverage", "cards", "mask_tables", "review", "datasets", "audits", "operations")


def load_all():
    """Import every family and return the registry module."""
    for family in FAMILIES:
        import_module(f"sightline.plans.{family}")
    return import_module("sightline.plans.registry")
