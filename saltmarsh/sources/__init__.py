"""Readers, writers and the measurement views over the benchmark tables."""
