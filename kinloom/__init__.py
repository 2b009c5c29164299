"""Kinship analytics on Spark: family trees, DNA matches and how they connect."""
