"""porespan: random microstructures and their transport, as Spark jobs."""

__version__ = "0.1.0"
