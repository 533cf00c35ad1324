"""Longitudinal rank-cutoff analytics as DataFrame -> DataFrame operators on Spark."""
