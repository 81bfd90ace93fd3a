"""fleetlens: Spark-native analytics over the telemetry of model-serving fleets."""

__version__ = "0.1.0"
