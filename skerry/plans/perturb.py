"""Perturbing an ensemble over cycles: definitions, random fields with memory, and their application."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.operators import fields as derived
from skerry.operators import grid as grids
from skerry.operators import spectral
from skerry.sources.tables import StateStore


@dataclass(frozen=True)
class Perturbation:
    """Perturbations of variables on scales: an amplitude for each variable and scale, lengths and times for each scale.

    ``kind`` is ``add`` or ``lognormal``, ``bounds`` are a variable's least and largest value. With
    ``wind_from`` the named variable's noise also gives the noise of the two wind components.
    """

    variables: Sequence[str] | str
    amp: Sequence | float
    hcorr: Sequence[float] | float
    tcorr: Sequence[float] | float
    kind: str = "add"
    bounds: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    wind_from: str | None = None
    wind: tuple[str, str] = ("u", "v")


def options(given: Perturbation) -> tuple[list[str], list[list[float]], list[float], list[float]]:
    """Variables, amplitudes by variable and scale, lengths and times by scale; numbers stand for all, other lengths are an error."""
    listed = lambda x: list(x) if isinstance(x, (list, tuple)) else [x]
    names, lengths, times = ([given.variables] if isinstance(given.variables, str) else list(given.variables)), listed(given.hcorr), listed(given.tcorr)
    scales = max(len(lengths), len(times))

    def fit(values: list, count: int, what: str) -> list:
        if len(values) not in (1, count):
            raise ValueError(f"{len(values)} {what} for {count}")
        return values * count if len(values) == 1 else values

    amp = [fit(listed(a), scales, "amplitudes") for a in fit(listed(given.amp), len(names), "variables' amplitudes")]
    return names, [list(map(float, a)) for a in amp], fit(lengths, scales, "lengths"), fit(times, scales, "times")


def perturb(state: DataFrame, defs: Sequence[Perturbation], grid: grids.Grid, store: StateStore, cycle: int, dt_hours: float, seed: int = 0) -> DataFrame:
    """``name, mem, i, j, value`` of ``state`` with the perturbations of a cycle.

    Each definition's noise on each scale is drawn for every member, blended with that of the cycle before
    by the scale's memory, and kept in ``store`` for the next one. Variables that no definition names pass
    through. Definitions and scales are few; members and points are what is distributed.
    """
    members = state.select("mem").distinct()
    out = state.select("name", "mem", "i", "j", "value")
    for d, given in enumerate(defs):
        names, amps, lengths, times = options(given)
        noise = []
        for v, name in enumerate(names):
            for s, (length, time) in enumerate(zip(lengths, times)):
                keys = members.select(F.lit(cycle).alias("cycle"), F.lit(1000 * d + 10 * v + s).alias("draw"), "mem")
                drawn = spectral.random_fields(keys, ["cycle", "draw", "mem"], grid.ny, grid.nx, 1.0, length, seed=seed).drop("cycle", "draw")
                tag = f"noise-{d}-{v}-{s}"
                if cycle:
                    drawn = spectral.blend(drawn, store.read(cycle - 1, tag), ["mem", "i", "j"], spectral.memory_weight(dt_hours, time))
                drawn = store.write(drawn, cycle, tag)
                noise.append(drawn.select(F.lit(name).alias("name"), "mem", "i", "j", (F.col("value") * amps[v][s]).alias("value")))
        whole = reduce(DataFrame.unionAll, noise).groupBy("name", "mem", "i", "j").agg(F.sum("value").alias("value"))
        if given.wind_from:
            pressure = whole.where(F.col("name") == given.wind_from).drop("name")
            flow = derived.geostrophic(pressure, ["mem"], 1.0, 1.2, 1.0)
            for name, c in zip(given.wind, ("u", "v")):
                whole = whole.unionByName(flow.select(F.lit(name).alias("name"), "mem", "i", "j", F.col(c).alias("value")))
        met = out.join(whole.withColumnRenamed("value", "p"), ["name", "mem", "i", "j"], "left")
        value = F.col("value") + F.col("p") if given.kind == "add" else F.col("value") * F.exp(F.col("p"))
        value = F.coalesce(value, F.col("value"))
        for name, (low, high) in given.bounds.items():
            kept = F.greatest(value, F.lit(low)) if low is not None else value
            kept = F.least(kept, F.lit(high)) if high is not None else kept
            value = F.when(F.col("name") == name, kept).otherwise(value)
        out = met.select("name", "mem", "i", "j", value.alias("value"))
    return out
