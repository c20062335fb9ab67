"""All registered queries; importing this module fills the registry."""

from __future__ import annotations

from . import (clustering, evaluation, models, neighbors, preprocess, search,  # noqa: F401
               text_sources, trees)
from .registry import ORACLE, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return {k: v for k, v in ORACLE.items() if k in QUERIES}
