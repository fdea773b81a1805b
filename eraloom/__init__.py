"""Longitudinal event analytics as Spark DataFrame operators."""
