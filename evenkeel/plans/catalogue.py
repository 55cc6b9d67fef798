"""All queries of the library, without those of the training-data subpackage."""

from . import evaluating, features, frames, series, streams, tables  # noqa: F401
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
