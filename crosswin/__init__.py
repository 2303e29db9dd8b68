"""Windowed analytics over paired event and telemetry recordings, on Spark."""
