"""Payments analytics as composable PySpark DataFrame jobs."""
