"""Loops over tables: lineage cuts, checkpoints, logs."""
