"""Continuous replication."""
