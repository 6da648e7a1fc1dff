"""Registered queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from importlib import import_module

MODULES = ("psi", "csi", "gini", "data", "population")


def collect(name: str) -> dict:
    result: dict = {}
    for module in MODULES:
        for key, value in getattr(import_module(f"{__name__}.{module}"), name).items():
            if key in result:
                raise ValueError(f"{key} is registered twice")
            result[key] = value
    return result
