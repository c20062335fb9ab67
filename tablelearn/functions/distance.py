"""Dense block kernels: Minkowski distances from coordinate differences.

The differences are taken coordinate by coordinate, at any width: no
expansion into norms and products, which cancels for data far from the
origin.  Memory is two ``rows x rows`` blocks, whatever the width.
"""

from __future__ import annotations

import math

import numpy as np


def minkowski(xa: np.ndarray, xb: np.ndarray, p: float = 2.0) -> np.ndarray:
    """Distances between the rows of two blocks."""
    total, diff = np.zeros((xa.shape[0], xb.shape[0])), np.empty((xa.shape[0], xb.shape[0]))
    for j in range(xa.shape[1]):
        np.subtract(xa[:, j][:, None], xb[:, j][None, :], out=diff)      # in place: two blocks, and no more
        if p == 2.0:
            np.multiply(diff, diff, out=diff)
        else:
            np.abs(diff, out=diff)
            if p != 1.0 and not math.isinf(p):
                np.power(diff, p, out=diff)
        if math.isinf(p):
            np.maximum(total, diff, out=total)
        else:
            np.add(total, diff, out=total)
    if p == 2.0:
        return np.sqrt(total, out=total)
    return total if p == 1.0 or math.isinf(p) else np.power(total, 1.0 / p, out=total)
