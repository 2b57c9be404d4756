"""Rolling- and expanding-window analytics for Spark DataFrames."""
from .operators import *  # noqa: F403
from .operators import __all__  # noqa: F401
