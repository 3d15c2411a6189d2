"""SQL statements that must give the same rows in another engine."""

from importlib import import_module

MODULES = ("detectors", "reports", "issues", "actions", "documents", "quality")


def all_oracles() -> dict[str, str]:
    merged: dict[str, str] = {}
    for name in MODULES:
        merged |= import_module(f"tillwatch.oracle.{name}").ORACLE
    return merged
