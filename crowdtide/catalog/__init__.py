"""Every registered query; importing the modules fills the registry."""

from . import figures, landing, lists, merging, scalars, trips  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
