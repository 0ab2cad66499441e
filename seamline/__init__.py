"""Spark-first telemetry lakehouse and corpus-preparation engine."""
