"""All queries of the library; importing this module registers them."""

from __future__ import annotations

from . import detection, labelling, media, requests  # noqa: F401
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
