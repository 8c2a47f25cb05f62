"""Context analytics on Spark: ordered chunk tables, health reports and declarative context transforms."""

__version__ = "0.1.0"
