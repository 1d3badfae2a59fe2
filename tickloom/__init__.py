"""Market-research analytics as Spark jobs: every operator maps DataFrames and explicit parameters to a DataFrame."""

__version__ = "0.1.0"
