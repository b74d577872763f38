"""Match-telemetry analytics as plain Spark jobs: batch, streaming and MLlib."""

__version__ = "0.1.0"
