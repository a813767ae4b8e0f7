"""tidegrid: market-bar features and news sentiment as Spark DataFrame jobs."""

__version__ = "0.1.0"
