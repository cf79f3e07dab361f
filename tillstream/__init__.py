"""Retail till analytics as plain DataFrame -> DataFrame functions on Spark."""
