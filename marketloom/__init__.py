"""Equity analytics as Spark jobs: momentum ranks, scores, valuation, screeners, archive."""
