"""Expected-threat surface: built once with numpy (768 numbers), carried as an array literal."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import clip
from .geometry import PITCH_LENGTH, PITCH_WIDTH, grid_cell


def _smooth(grid: np.ndarray, sigma: float, axis: int, truncate: float = 4.0) -> np.ndarray:
    """Gaussian filter along one axis, half-sample reflection at the edges."""
    radius = int(truncate * sigma + 0.5)
    offsets = np.arange(-radius, radius + 1)
    kernel = np.exp(-0.5 * (offsets / sigma) ** 2)
    kernel /= kernel.sum()
    pad = [(radius, radius) if a == axis else (0, 0) for a in range(grid.ndim)]
    padded = np.pad(grid, pad, mode="symmetric")
    return np.apply_along_axis(lambda line: np.convolve(line, kernel, mode="valid"), axis, padded)


def gaussian(grid: np.ndarray, sigma: float) -> np.ndarray:
    return _smooth(_smooth(grid, sigma, 0), sigma, 1)


@lru_cache(maxsize=16)
def _surface(n_x: int, n_y: int, length: float, width: float, peak: float) -> tuple:
    x = (np.arange(n_x) + 0.5) / n_x * length
    y = (np.arange(n_y) + 0.5) / n_y * width
    depth = (x / length)[:, None]
    central = np.clip(1 - np.abs(y - width / 2) / (width / 2), 0, 1)[None, :]
    reach = np.hypot(length, width / 2)
    near = np.clip(1 - np.hypot((length - x)[:, None], (y - width / 2)[None, :]) / reach, 0, 1)
    raw = 0.005 + 0.035 * depth**1.8 + 0.090 * depth**3.2 * central + 0.220 * near**5.0 * central**1.5
    smooth = gaussian(raw, 0.8)
    scaled = smooth / smooth.max() * peak
    return tuple(tuple(float(v) for v in row) for row in scaled)


def xt_surface(n_x: int = 32, n_y: int = 24, length: float = PITCH_LENGTH, width: float = PITCH_WIDTH,
               peak: float = 0.32) -> np.ndarray:
    return np.array(_surface(n_x, n_y, length, width, peak))


def xt_value(x, y, n_x: int = 32, n_y: int = 24, length: float = PITCH_LENGTH, width: float = PITCH_WIDTH) -> Column:
    """xT of a position in metres (attack towards growing x), positions clipped to the pitch."""
    flat = [v for row in _surface(n_x, n_y, length, width, 0.32) for v in row]
    cell = grid_cell(clip(x, 0, length), length, n_x) * n_y + grid_cell(clip(y, 0, width), width, n_y)
    return F.try_element_at(F.array(*[F.lit(v) for v in flat]), cell + 1)
