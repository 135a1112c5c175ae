"""Exact distance of every grid point to the nearest masked one, by columns, then by rows.

Within a column the nearest masked point is the last before or the first after, two windows. Along a row
the squared distance is the least of ``(i - k)^2 + g(k)^2`` over its columns ``k``, the lower envelope of
parabolas; a task holds rows of the grid one at a time, in which it builds the envelope and walks it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _along_columns(mask: DataFrame, keys: list[str]) -> DataFrame:
    """``g``: steps to the nearest masked point of the column, null where it has none."""
    order = Window.partitionBy(*keys, "i").orderBy("j")
    here = F.when(F.col("masked"), F.col("j"))
    before, after = F.last(here, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), F.first(here, ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    return mask.withColumn("g", F.least(F.col("j") - before, after - F.col("j")).cast("double"))


def envelope_distance(place: np.ndarray, height: np.ndarray, stretch: float) -> np.ndarray:
    """Least of ``(stretch * (x - place_k))^2 + height_k`` at each ``place``; heights may be infinite."""
    known = np.flatnonzero(np.isfinite(height))
    if not len(known):
        return np.full(len(place), np.inf)
    feet, starts = [known[0]], [-np.inf]  # parabolas of the envelope and where each takes over
    square = stretch * stretch
    lift = height + square * place.astype(float) ** 2
    for k in known[1:]:
        while True:
            last = feet[-1]
            cross = (lift[k] - lift[last]) / (2 * square * (place[k] - place[last]))
            if cross > starts[-1]:
                break
            feet.pop()
            starts.pop()
        feet.append(k)
        starts.append(cross)
    of = np.array(feet)[np.searchsorted(starts, place, "left").clip(1) - 1]
    return square * (place - place[of]).astype(float) ** 2 + height[of]


def distance_to_mask(mask: DataFrame, keys: list[str] = [], dx: float = 1.0, dy: float = 1.0) -> DataFrame:  # noqa: B006
    """``keys, i, j, gap`` of ``mask(keys, i, j, masked)``: straight distance to the nearest masked point, zero on it.

    Null where a grid has no masked point. A null mark counts as not masked; points may be missing.
    """
    rows = _along_columns(mask.select(*keys, "i", "j", F.coalesce("masked", F.lit(False)).alias("masked")), keys)

    def along_row(row: pd.DataFrame) -> pd.DataFrame:
        row = row.sort_values("i")
        found = envelope_distance(row["i"].to_numpy(), (dy * row["g"].to_numpy(np.float64, na_value=np.inf)) ** 2, dx)
        return row[[*keys, "i", "j"]].assign(gap=np.sqrt(found))

    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*keys, "i", "j"])
    out = rows.select(*keys, "i", "j", "g").groupBy(*keys, "j").applyInPandas(along_row, f"{types}, gap double")
    return out.withColumn("gap", F.when(F.col("gap") < float("inf"), F.col("gap")))


def shore_mask(points: DataFrame, masked: DataFrame, nx: int, ny: int, cyclic_x: bool = False, cyclic_y: bool = False) -> DataFrame:
    """``i, j, masked`` of all ``points(i, j)``: those of ``masked(i, j)`` and the edges across which the grid does not go on."""
    edge = F.lit(False)
    if not cyclic_x:
        edge = edge | F.col("i").isin(0, nx - 1)
    if not cyclic_y:
        edge = edge | F.col("j").isin(0, ny - 1)
    marks = masked.select("i", "j", F.lit(True).alias("hidden")).distinct()
    return points.join(marks, ["i", "j"], "left").select("i", "j", (F.coalesce("hidden", F.lit(False)) | edge).alias("masked"))
