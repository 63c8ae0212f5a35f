"""Batch claim verification and corpus analytics on Spark."""
