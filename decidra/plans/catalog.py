"""Imports every plan module, so that the registry is complete."""

from decidra.plans import datasets, decisions, replays, reports, scoring, workbench  # noqa: F401
from decidra.plans.registry import QUERIES, SQL  # noqa: F401
