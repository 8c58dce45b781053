"""Imports every query module so that the registry is complete."""

from skyledger.plans import arrays, catalog, evaluation, ingest, matching, models, validation  # noqa: F401
from skyledger.plans.registry import ORACLES, QUERIES  # noqa: F401
