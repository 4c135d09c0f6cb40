"""All registered queries of the mesh library."""

from __future__ import annotations

from functools import cache

from . import faces, formulas, meshes
from .registry import Registry


@cache
def registry() -> Registry:
    reg = Registry()
    formulas.add_all(reg)
    meshes.add_all(reg)
    faces.add_all(reg)
    return reg


def queries():
    return dict(registry().queries)


def oracle_sql():
    return dict(registry().sql)
