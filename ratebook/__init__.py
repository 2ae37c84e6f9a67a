"""Tariff pricing analytics on Spark: policy build, objectives, fits, reports."""

__version__ = "0.1.0"
