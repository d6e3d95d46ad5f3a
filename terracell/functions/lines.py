"""Lines: simplification and rounding of coordinates, ids of border points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

LINE = "array<struct<lon:double,lat:double>>"


def _off(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of points from the segment a-b."""
    d = b - a
    size = d @ d
    t = np.clip((points - a) @ d / size, 0, 1) if size > 0 else np.zeros(len(points))
    return ((points - a - t[:, None] * d) ** 2).sum(axis=1)


def thinned(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas-Peucker: which points stay. Ends stay; of the farthest points the first decides; distance must exceed the tolerance."""
    stay = np.zeros(len(points), bool)
    if len(points):
        stay[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo < 2:
            continue
        off = _off(points[lo + 1 : hi], points[lo], points[hi])
        k = int(off.argmax())
        if off[k] > tolerance * tolerance:
            stay[lo + 1 + k] = True
            todo += [(lo, lo + 1 + k), (lo + 1 + k, hi)]
    return stay


def simplified(line: Column, tolerance: float, digits: int) -> Column:
    """A line thinned, rounded (half to even of the exact value), without repeated neighbours; null stays null."""

    @F.pandas_udf(LINE)
    def each(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lines in parts:
            out = []
            for one in lines:
                if one is None:
                    out.append(None)
                    continue
                points = np.array([(p["lon"], p["lat"]) for p in one], np.float64).reshape(-1, 2)
                rounded = [(round(x, digits), round(y, digits)) for x, y in points[thinned(points, tolerance)].tolist()]
                out.append([{"lon": x, "lat": y} for k, (x, y) in enumerate(rounded) if k == 0 or (x, y) != rounded[k - 1]])
            yield pd.Series(out, dtype=object)

    return each(line)


def portal_id(res: int, lon: Column, lat: Column) -> Column:
    """A negative id, 52 bits at most, of a point on a border: the same from either side."""
    text = F.format_string("%d|%.9f|%.9f", F.lit(res), lon, lat)
    return -F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("long")
