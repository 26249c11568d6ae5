"""Panels of time series on Spark: ingestion, alignment, transformation, selection, diagnostics and tests.

The canonical panel is long: one row for every (series, sasdate), value NULL where
missing. NaN and infinities never enter it.
"""
