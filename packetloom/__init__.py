"""Traffic dataset preparation and evaluation as Spark DataFrame transformations."""

__version__ = "0.1.0"
