"""vecloom: vector analytics and corpus preparation as PySpark DataFrame plans."""

__version__ = "0.1.0"
