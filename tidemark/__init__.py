"""Business-analytics operators over Spark DataFrames.

Every operator takes a DataFrame with explicit column names and returns a DataFrame. Nothing here
holds state, and nothing pulls row-level data to the driver.
"""

__version__ = "0.1.0"
