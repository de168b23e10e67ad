"""All registered queries; importing the modules fills the registry."""
from . import annotation, contracts, measurement, statistics  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
