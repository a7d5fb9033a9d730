"""Scalar constants and helpers, complex split and combine, and bandwidth queries."""

from .scalars import ScalarTraits, combine, split
from .stream import bench_stream

__all__ = ["ScalarTraits", "bench_stream", "combine", "split"]
