"""meshscope: ownership-network analytics on Spark DataFrames.

Cleaning and profiling of an ownership edge list, capital-weighted opacity
propagation, ultimate-owner expansion, family indices and result reports,
all expressed with the DataFrame API and built-in functions.
"""

from meshscope.session import build_session

__all__ = ["build_session"]
