"""evidra: evidence analytics over operational telemetry, expressed as Spark plans."""

__version__ = "0.1.0"
