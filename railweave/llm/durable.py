"""Cutting lineage, as the rest of the library does it."""

from ..checkpoints import stored as checkpointed

__all__ = ["checkpointed"]
