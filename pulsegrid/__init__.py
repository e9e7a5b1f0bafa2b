"""Pulsegrid: activity analytics as Spark DataFrame jobs."""
