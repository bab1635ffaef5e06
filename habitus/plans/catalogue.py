"""Importing this module registers every query."""

from habitus.plans import (  # noqa: F401
    deciding,
    geography,
    ingesting,
    live,
    modelling,
    monitoring,
    normalisation,
    profiling,
    serving,
    training,
)
from habitus.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
