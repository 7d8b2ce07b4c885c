"""Registered queries. Importing a module here registers its queries."""

from importlib import import_module

MODULES = ("market", "filings", "pit", "splits", "models", "profile", "audits", "faults")


def load_all() -> None:
    for name in MODULES:
        import_module(f"pitline.plans.{name}")
