"""Benchmark bindings: importing this package registers every query."""

from . import aggregates, basics, features, images, joins, longitudinal, models, quality, scalars, sources, transforms  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
