"""All registered queries; importing the modules registers them."""

from . import documents, files, game, geometry, intake, layer1, people, poses, reviews, settings  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
