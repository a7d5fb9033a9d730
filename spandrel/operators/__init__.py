"""Kernels and solvers."""
