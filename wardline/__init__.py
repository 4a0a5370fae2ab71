"""Fleet-scale governance of AI-service usage, as Spark DataFrame operators."""

__version__ = "0.1.0"
