"""Compound screening and chemometrics tables as PySpark DataFrame operators."""
