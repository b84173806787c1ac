"""Queries of the statement analysis and their SQL."""

from rebill.plans import files, oracles, subscriptions, tables

QUERIES = subscriptions.QUERIES | files.QUERIES | tables.QUERIES
ORACLES = oracles.ORACLES | files.ORACLES | tables.ORACLES
