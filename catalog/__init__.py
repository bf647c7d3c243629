"""Registered queries over the given tables."""

from catalog import learning, profile, scoring, transform  # noqa: F401
from catalog.base import ORACLES, QUERIES  # noqa: F401
