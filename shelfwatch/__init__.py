"""Catalog monitoring on Spark: sources, identity, baselines, rules, incident life cycles, alerts and read models."""
