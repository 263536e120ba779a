"""tidelake: market-data and order-execution analytics on plain PySpark."""

__all__ = ["__version__"]
__version__ = "0.1.0"
