"""Column expressions that the operators are made of."""

from .finite import finite, nan_if_null

__all__ = ["finite", "nan_if_null"]
