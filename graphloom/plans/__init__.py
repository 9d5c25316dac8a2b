"""Plan helpers: lineage cuts, sizing and iteration control."""

from .batches import bound_batches
from .scratch import Scratch, shared_dir, shuffle_partitions

__all__ = ["Scratch", "bound_batches", "shared_dir", "shuffle_partitions"]
