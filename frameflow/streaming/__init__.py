"""Rolling statistics of streams."""

from .rolling import rolling_stream

__all__ = ["rolling_stream"]
