"""Operators: joins, aggregates, reports, distributed ranks, splits, metrics, curves, fits, trees."""
