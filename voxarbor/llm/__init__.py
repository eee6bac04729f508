"""Operators for training-data pipelines; ``QUERIES`` and ``ORACLES`` hold their registered queries."""

from voxarbor.llm.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
