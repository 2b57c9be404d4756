"""Reading series from files, and writing results."""

from .tables import read_series, read_table, write_results

__all__ = ["read_series", "read_table", "write_results"]
