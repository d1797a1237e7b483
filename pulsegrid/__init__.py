"""Telemetry metrics, round-robin history and event logs as Spark plans."""
