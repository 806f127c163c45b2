"""Sinks: JSON lines, CSV, tables and metrics, all written by the executors."""
