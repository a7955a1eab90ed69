"""fieldcast: weather-driven work decisions as Spark DataFrame operators."""

__version__ = "0.1.0"
