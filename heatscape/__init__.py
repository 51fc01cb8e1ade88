"""Spatial heat-driver analytics as Spark DataFrame operators."""
