"""Recurring-charge analytics on Spark."""
