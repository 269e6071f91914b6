"""Connected components of an edge table: the library's own."""

from __future__ import annotations

from ..operators.components import components

__all__ = ["components"]
