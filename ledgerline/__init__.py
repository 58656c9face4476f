"""Filings analytics and corpus preparation on Spark."""
