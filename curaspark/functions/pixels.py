"""Quality of gray pictures: edges, second derivatives and block borders, as stencils over whole arrays in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("sharpness", "detail", "blur", "blockiness")])
# Weights of the measures, the size of a coding block, and the size at which detail is full.
EDGE, EDGE_GAIN, LAPLACE, LAPLACE_GAIN = 0.55, 2.8, 0.45, 8.0
RESOLUTION, SHARPNESS, BLOCKINESS, BLOCK_GAIN, BLOCK = 0.65, 0.35, 0.15, 4.0, 8
FULL = (1280.0, 720.0)


def _unit(x: float) -> float:
    return max(0.0, min(1.0, x))


def measured(pixels: np.ndarray, width: int, height: int) -> tuple[float, float, float, float]:
    """sharpness, detail, blur, blockiness of gray values 0 to 255 (rows, columns) of an image of that original size."""
    p = pixels.astype(np.int64)
    edges = p.copy()  # the border keeps its values
    if min(p.shape) > 2:
        around = sum(p[1 + dy : p.shape[0] - 1 + dy, 1 + dx : p.shape[1] - 1 + dx] for dy in (-1, 0, 1) for dx in (-1, 0, 1))
        c, left, up = p[1:-1, 1:-1], p[1:-1, :-2], p[:-2, 1:-1]
        edges[1:-1, 1:-1] = np.clip(9 * c - around, 0, 255)
        second = np.abs(4 * c - left - p[1:-1, 2:] - up - p[2:, 1:-1])
        across, down = np.abs(c - left), np.abs(c - up)
        x, y = np.arange(1, p.shape[1] - 1) % BLOCK, np.arange(1, p.shape[0] - 1) % BLOCK
        border = np.concatenate([across[:, x == 0].ravel(), down[y == 0].ravel()])
        inside = np.concatenate([across[:, x == 1].ravel(), down[y == 1].ravel()])
    else:
        second = border = inside = np.zeros(0, np.int64)
    mean = lambda v: v.sum() / max(1, v.size)
    edge, laplace = mean(edges) / 255.0, mean(second) / 1020.0
    blocks = _unit((mean(border) - mean(inside)) / 255.0 * BLOCK_GAIN)
    sharp = _unit(EDGE * edge * EDGE_GAIN + LAPLACE * laplace * LAPLACE_GAIN)
    full = _unit(min(width / FULL[0], height / FULL[1]))
    detail = _unit(RESOLUTION * full + SHARPNESS * sharp - BLOCKINESS * blocks)
    return sharp, detail, _unit(1.0 - laplace * LAPLACE_GAIN), blocks


@F.pandas_udf(METRICS)
def quality(pixels: pd.Series, columns: pd.Series, width: pd.Series, height: pd.Series) -> pd.DataFrame:
    """Metrics of gray values row by row with that many columns, not rounded; nulls where they make no picture."""
    out = []
    for p, n, w, h in zip(pixels, columns, width, height, strict=True):
        whole = p is not None and not pd.isna(n) and n > 0 and len(p) > 0 and len(p) % n == 0 and not pd.isna(w) and not pd.isna(h)
        out.append(measured(np.asarray(p).reshape(-1, int(n)), w, h) if whole else (None,) * 4)
    return pd.DataFrame(out, columns=[f.name for f in METRICS.fields])
