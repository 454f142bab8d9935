"""Scalar functions, all built of JVM-side expressions."""
