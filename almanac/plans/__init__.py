"""Registered queries, one module per family."""

from importlib import import_module

from .registry import ORACLES, QUERIES

FAMILIES = ("panel", "evaluation", "alignment", "splitting", "matrix", "sources", "reshaping", "scalars", "quality", "rivers", "streams")


def _import_all():
    for name in FAMILIES:
        import_module(f"{__name__}.{name}")


def all_queries():
    _import_all()
    return dict(QUERIES)


def all_oracles():
    _import_all()
    return dict(ORACLES)
