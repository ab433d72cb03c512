"""Ferrule: table assessment, loading, replication and validation as PySpark plans."""
