"""Spark analytics for multichannel recordings."""
