"""How a row frame is laid out over partitions."""

from .frames import Series, check_columns
from .halo import halo_blocks

__all__ = ["Series", "check_columns", "halo_blocks"]
