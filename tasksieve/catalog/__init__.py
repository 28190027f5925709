"""The registered queries; importing the modules registers them."""

from tasksieve.catalog import cleaning, learning, masking, profiles, relabel, topics  # noqa: F401
from tasksieve.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
