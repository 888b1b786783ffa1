"""Retail offer analytics on Spark: sources, offer queries, product matching and writes as DataFrame functions."""
