"""Constants of the scalar types, and complex columns as pairs of real ones."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from ..operators.vec import combine, split
from ..types import SCALARS, SolverError

__all__ = ["ScalarTraits", "combine", "split"]


@dataclass(frozen=True)
class ScalarTraits:
    """Of S, D, C or Z: machine precision, the tolerance of rank decisions, and whether values are complex."""

    letter: str

    def __post_init__(self):
        if self.letter not in SCALARS:
            raise SolverError(f"no scalar type {self.letter!r}")

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(SCALARS[self.letter])

    @property
    def is_complex(self) -> bool:
        return self.dtype.kind == "c"

    @property
    def eps(self) -> float:
        return float(np.finfo(self.dtype).eps)

    def rank_tol(self, robust: bool = False) -> float:
        return 1e-12 if robust and self.letter in "DZ" else 10 * self.eps
