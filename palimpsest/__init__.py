"""Versioned, evidence-backed document analytics as Spark DataFrame operators."""
