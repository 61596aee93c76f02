"""Rank-statistics and corpus analytics on Spark."""
