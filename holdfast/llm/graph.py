"""Connected components of an edge table."""

from ..operators.graph import connected_components

__all__ = ["connected_components"]
