"""Readers and writers of the telemetry formats."""
