"""Indexes: side tables that are tagged with the table version they cover."""

from vecloom.operators.indexes.kinds import KINDS, build

__all__ = ["KINDS", "build"]
