"""Keyword-trigger analytics as Spark DataFrame operators.

Every operator takes and returns DataFrames and names its columns through
arguments.  Nothing here collects rows to the driver.
"""

__version__ = "0.1.0"
