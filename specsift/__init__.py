"""specsift: analytics of requirements and technical documents on Spark."""

__version__ = "0.1.0"
