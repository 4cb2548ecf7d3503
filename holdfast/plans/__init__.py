"""Registered queries and the views that they run on."""

from . import models, places, scores, structure, volumes
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "models", "places", "scores", "structure", "volumes"]
