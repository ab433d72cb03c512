"""Scalar functions: canonical values, type mapping, naming."""
