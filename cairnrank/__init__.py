"""Ranked-retrieval and screening analytics as composable PySpark DataFrame operators."""
