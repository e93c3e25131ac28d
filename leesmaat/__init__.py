"""Readability analytics and text-data preparation on Spark DataFrames."""

from leesmaat.api import Analysis, Readability
from leesmaat.sources.lexicons import Lexicons

__all__ = ["Analysis", "Lexicons", "Readability"]
__version__ = "0.2.0"
