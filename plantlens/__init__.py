"""Sensor-table analytics and document search written as Spark jobs."""

__version__ = "0.1.0"
