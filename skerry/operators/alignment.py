"""Displacements between two states of a field, and updates that move the field before they correct it.

The displacement is found on an image pyramid, coarse levels first: the first field is warped by what is
known so far, both are averaged to the level, and a smooth increment that explains their difference is
found by Jacobi sweeps. Fields lie on a square whose side is a power of two, with the corner at its origin;
only cells that the field's values can reach are kept as a table, all others are zero, masked and do not
move, so that a long and narrow field has no more rows than its length asks for. For the sweeps of a level
cells are dealt into tiles, and tiles without cells are left out. A tile holds ``halo`` more cells on each
side and so can do as many sweeps by itself; then tiles exchange their edges in one shuffle. A task holds a
tile, never a field, and the result does not depend on the tiles. Tables of cells are joined by sorting:
their files may be small when their rows are many, and broadcasting them would fill the driver.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.operators.grid import Grid
from skerry.sources.tables import StateStore

LEVELS, SWEEPS, TOLERANCE, SMOOTHNESS = 5, 100, 1e-3, 1.0
TILE, HALO = 256, 20
#: Cells whose value changes less than this carry no information.
UNCHANGED = 1e-5


def _neighbours(d: np.ndarray) -> np.ndarray:
    """Mean of the eight neighbours, the four near ones with twice the weight; edges wrap."""
    near = sum(np.roll(d, s, axis) for s in (1, -1) for axis in (-1, -2))
    across = sum(np.roll(np.roll(d, s, -2), t, -1) for s in (1, -1) for t in (1, -1))
    return near / 6 + across / 12


class _Sweeps:
    """Jacobi sweeps over one array of cells; ``slopes`` are d/dx, d/dy and the change, ``fixed`` cells do not move."""

    def __init__(self, slopes: np.ndarray, fixed: np.ndarray, weight: float):
        self.slopes, self.fixed = slopes, fixed
        self.scale = weight + slopes[0] ** 2 + slopes[1] ** 2

    def once(self, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.where(self.fixed, 0.0, d)
        mean, (x, y, t) = _neighbours(d), self.slopes
        new = mean - np.stack((x, y)) * ((x * mean[0] + y * mean[1] + t) / self.scale)
        return new, np.abs(new - d).sum(axis=0)


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a, "<f8").tobytes()


class _Tiling:
    """``n`` by ``n`` cells in square tiles; one tile wraps around and needs no halo."""

    def __init__(self, keys: list[str], n: int, tile: int, halo: int):
        self.keys, self.n = keys, n
        self.tile = min(tile, n)
        self.count = n // self.tile
        self.halo = min(halo, self.tile - 1) if self.count > 1 else 0
        self.width = self.tile + 2 * self.halo

    def dealt(self, cells: DataFrame, rim: int) -> DataFrame:
        """Every cell to the tiles that hold it, ``r, c`` its place there; ``rim`` cells more than the halo."""
        if self.count == 1:
            return cells.select("*", F.lit(0).alias("ti"), F.lit(0).alias("tj"), F.col("i").alias("c"), F.col("j").alias("r"))
        reach, t = self.halo + rim, self.tile
        for axis, tile, place in (("j", "ti", "r"), ("i", "tj", "c")):
            options = F.array(*[F.struct(F.pmod(F.floor(F.col(axis) / t) + d, F.lit(self.count)).cast("int").alias("tile"), (F.pmod(F.col(axis), F.lit(t)) - d * t + reach).cast("int").alias("place")) for d in (-1, 0, 1)])
            cells = cells.select("*", F.explode(F.filter(options, lambda o: (o["place"] >= 0) & (o["place"] < t + 2 * reach))).alias("o")).select("*", F.col("o.tile").alias(tile), F.col("o.place").alias(place)).drop("o")
        return cells

    def fixed(self, ti: int, tj: int, masked: np.ndarray) -> np.ndarray:
        """Masked cells and those at the edge of the square."""
        rows, cols = ((np.arange(self.width) - self.halo + t * self.tile) % self.n for t in (ti, tj))
        edge = lambda x: (x == 0) | (x == self.n - 1)
        return masked | edge(rows)[:, None] | edge(cols)[None, :]

    def inner(self, a: np.ndarray) -> np.ndarray:
        return a[..., self.halo : self.halo + self.tile, self.halo : self.halo + self.tile]


def _grouped(f: Callable[[pd.DataFrame], pd.DataFrame], keys: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = f(rows)
        for k in keys:
            out[k] = [rows[k].iloc[0]] * len(out)
        return out

    return run


def _solve(level: DataFrame, tiling: _Tiling, store: StateStore, name: str, sweeps: int, tolerance: float, weight: float) -> DataFrame:
    """``keys, i, j, du, dv`` of the level's cells ``keys, i, j, x1, x2, masked``."""
    keys, wide = tiling.keys, tiling.count > 1
    types = ", ".join(f"`{k}` {level.schema[k].dataType.simpleString()}" for k in keys)
    state = f"ti int, tj int, slopes binary, fixed binary, d binary, before binary, changes array<double>, {types}"
    rim = 1 if wide else 0
    side, tile, width, halo = tiling.width + 2 * rim, tiling.tile, tiling.width, tiling.halo

    def swept(ti: int, tj: int, slopes: np.ndarray, fixed: np.ndarray, d: np.ndarray, before: np.ndarray, most: int) -> pd.DataFrame:
        work, changes = _Sweeps(slopes, fixed, weight), []
        while len(changes) < most and (wide or not changes or changes[-1] > tolerance):
            d, change = work.once(d)
            changes.append(float(tiling.inner(change).max()))
        return pd.DataFrame({"ti": [ti], "tj": [tj], "slopes": [_bytes(slopes)], "fixed": [fixed.tobytes()], "d": [_bytes(tiling.inner(d))], "before": [_bytes(before)], "changes": [changes]})

    def first(rows: pd.DataFrame) -> pd.DataFrame:
        ti, tj = (int(rows[c].iloc[0]) for c in ("ti", "tj"))
        a = np.zeros((3, side, side))
        a[2] = 1  # cells that are not kept
        a[:, rows["r"], rows["c"]] = rows[["x1", "x2", "masked"]].to_numpy(np.float64).T
        mean = (a[0] + a[1]) / 2
        slopes = np.stack([(np.roll(mean, -1, 1) - np.roll(mean, 1, 1)) / 2, (np.roll(mean, -1, 0) - np.roll(mean, 1, 0)) / 2, a[1] - a[0]])
        cut = slice(rim, side - rim)
        masked = a[2, cut, cut] > 0
        return swept(ti, tj, slopes[:, cut, cut].copy(), tiling.fixed(ti, tj, masked), np.zeros((2, width, width)), np.zeros((2, tile, tile)), min(halo, sweeps) if wide else sweeps)

    def messages(frames):
        """Each tile's cells to itself and to the neighbours whose halo they are in, ``r, c`` their place there."""
        for frame in frames:
            out = []
            for row in frame.to_dict("records"):
                more = {k: row[k] for k in keys}
                d = np.frombuffer(row["before"] if row["todo"] >= 0 else row["d"]).reshape(2, tile, tile)
                for a in (-1, 0, 1):
                    for b in (-1, 0, 1):
                        r, c = halo - a * tile, halo - b * tile
                        block = d[:, max(0, -r) : width - r, max(0, -c) : width - c]
                        own = {x: row[x] if a == b == 0 else None for x in ("slopes", "fixed")}
                        out.append(more | own | {"ti": (row["ti"] + a) % tiling.count, "tj": (row["tj"] + b) % tiling.count, "r": max(0, r), "c": max(0, c), "h": block.shape[1], "block": _bytes(block), "own": a == b == 0, "todo": row["todo"]})
            yield pd.DataFrame(out)

    def later(most: int):
        def run(rows: pd.DataFrame) -> pd.DataFrame:
            if not rows["own"].any():  # no cells there, nothing moves
                return pd.DataFrame(columns=["ti", "tj", "slopes", "fixed", "d", "before", "changes"], dtype=object)
            d, mine = np.zeros((2, width, width)), rows[rows["own"]].iloc[0]
            for r, c, h, block in zip(rows["r"], rows["c"], rows["h"], rows["block"]):
                part = np.frombuffer(block).reshape(2, h, -1)
                d[:, r : r + h, c : c + part.shape[2]] = part
            slopes, fixed = np.frombuffer(mine["slopes"]).reshape(3, width, width), np.frombuffer(mine["fixed"], bool).reshape(width, width)
            return swept(int(mine["ti"]), int(mine["tj"]), slopes, fixed, d, tiling.inner(d), int(mine["todo"]) if mine["todo"] >= 0 else most)

        return run

    by = [*keys, "ti", "tj"]
    now = store.write(tiling.dealt(level, rim).groupBy(*by).applyInPandas(_grouped(first, keys), state), 0, name)
    ready, done = [], min(halo, sweeps)
    while wide:
        peak = now.select(*keys, F.posexplode("changes").alias("s", "change")).groupBy(*keys, "s").agg(F.max("change").alias("change"))
        stop = peak.where(F.col("change") <= tolerance).groupBy(*keys).agg((F.min("s") + 1).alias("todo"))
        judged = now.join(stop, keys, "left").withColumn("todo", F.coalesce("todo", F.lit(-1)))
        over = (F.col("todo") == F.size("changes")) | (F.lit(done >= sweeps) & (F.col("todo") < 0))
        ready.append(judged.where(over).drop("todo"))
        going = judged.where(~over)
        if going.isEmpty():
            break
        most = min(halo, sweeps - done) if done < sweeps else halo
        sent = f"ti int, tj int, r int, c int, h int, block binary, own boolean, todo int, slopes binary, fixed binary, {types}"
        now = store.write(going.mapInPandas(messages, sent).groupBy(*by).applyInPandas(_grouped(later(most), keys), state), done, name)
        done += most
    out = ready[0] if ready else now
    for more in ready[1:]:
        out = out.unionByName(more)

    def cells(frames):
        for frame in frames:
            for row in frame.to_dict("records"):
                d = np.frombuffer(row["d"]).reshape(2, -1)
                j, i = np.divmod(np.arange(tile * tile), tile)
                yield pd.DataFrame({k: row[k] for k in keys} | {"i": i + row["tj"] * tile, "j": j + row["ti"] * tile, "du": d[0], "dv": d[1]})

    return out.select(*by, "d").mapInPandas(cells, f"{types}, i bigint, j bigint, du double, dv double")


def _sampled(at: DataFrame, field: DataFrame, keys: list[str], n: int, values: list[str]) -> DataFrame:
    """``keys, i, j`` and ``values`` of a square field of side ``n`` at ``fi, fj`` of the rows, bilinear; edges wrap, cells that are not there are zero."""
    i0, j0 = F.floor("fi"), F.floor("fj")
    u, v = F.col("fi") - i0, F.col("fj") - j0
    corners = F.array(*[F.struct(F.pmod(i0 + a, F.lit(n)).alias("ci"), F.pmod(j0 + b, F.lit(n)).alias("cj"), ((u if a else 1 - u) * (v if b else 1 - v)).alias("w")) for a in (0, 1) for b in (0, 1)])
    wanted = at.select(*keys, "i", "j", F.explode(corners).alias("k")).select(*keys, "i", "j", "k.*").where("w <> 0")
    source = field.select(*keys, F.col("i").alias("ci"), F.col("j").alias("cj"), *values)
    met = wanted.join(source.hint("merge"), [*keys, "ci", "cj"], "left")
    return met.groupBy(*keys, "i", "j").agg(*[F.sum(F.col("w") * F.coalesce(F.col(x), F.lit(0.0))).alias(x) for x in values])


def _kept(n: int, length: int, levels: int) -> tuple[int, int]:
    """How many cells at the start and at the end of an axis of the square can be other than zero and masked.

    A level of blocks of side s carries values three blocks on at most: one whose slope sees a value, its
    neighbour by the mean, and one more by interpolation. Both numbers are whole blocks of the coarsest level.
    """
    sizes = [1 << max(level - 1, 0) for level in range(levels + 1)]
    reach = -(-3 * sum(sizes) // sizes[-1]) * sizes[-1]
    low = (-(-length // sizes[-1]) * sizes[-1]) + reach
    return (n, 0) if low + reach >= n else (low, reach)


def displacement(
    fields: DataFrame, keys: list[str], nx: int, ny: int, store: StateStore | None = None, levels: int = LEVELS, sweeps: int = SWEEPS, tolerance: float = TOLERANCE, smoothness: float = SMOOTHNESS, tile: int = TILE, halo: int = HALO
) -> DataFrame:
    """``keys, i, j, u, v``: by how many cells each cell of the first field moves to give the second.

    ``fields(keys, i, j, before, after)`` are scaled by the first one's range; null or NaN cells and those
    that do not change take no part and stay where they are at first. Levels run from ``levels`` to 0;
    level l averages squares of side ``2^(l-1)`` (one cell for 0) and counts for as much. A level ends
    when no cell changes by more than ``tolerance`` or after ``sweeps`` sweeps. Each level's tables are
    stored, so the plan does not grow.
    """
    store = store or StateStore.temporary(fields.sparkSession)
    n = 1 << max(1, int(np.ceil(np.log2(max(nx, ny)))))
    masked = F.col("before").isNull() | F.isnan("before") | F.col("after").isNull() | F.isnan("after") | (F.abs(F.col("after") - F.col("before")) < UNCHANGED)
    known = fields.select(*keys, F.col("i").cast("long"), F.col("j").cast("long"), *[F.when(masked, 0.0).otherwise(F.col(c).cast("double")).alias(x) for c, x in (("before", "x1"), ("after", "x2"))], masked.alias("masked"))
    top = min(levels, int(np.log2(n)))
    (low_i, high_i), (low_j, high_j) = _kept(n, nx, top), _kept(n, min(ny + 1, n), top)  # an incomplete row may follow
    wide = low_i + high_i
    place = lambda k, low, high: F.when(k < low, k).otherwise(k + (n - low - high)).cast("long")
    cells = fields.sparkSession.range(wide * (low_j + high_j))
    cells = cells.select(place(F.col("id") % wide, low_i, high_i).alias("i"), place(F.floor(F.col("id") / wide), low_j, high_j).alias("j"))
    square = cells.crossJoin(store.write(fields.select(*keys).distinct(), 0, "keys"))
    whole = square.join(known.hint("merge"), [*keys, "i", "j"], "left").select(*keys, "i", "j", F.coalesce("x1", F.lit(0.0)).alias("x1"), F.coalesce("x2", F.lit(0.0)).alias("x2"), F.coalesce("masked", F.lit(True)).alias("masked"))
    bounds = whole.groupBy(*keys).agg(F.min("x1").alias("low"), F.max("x1").alias("high"))
    # only differences count, so the low bound is not taken off: cells beyond the field stay zero
    scaled = lambda c: F.when(F.col("high") > F.col("low"), F.col(c) / (F.col("high") - F.col("low"))).otherwise(F.col(c)).alias(c)
    base = store.write(whole.join(bounds, keys).select(*keys, "i", "j", scaled("x1"), scaled("x2"), "masked"), 0, "base")
    moved = base.select(*keys, "i", "j", F.lit(0.0).alias("u"), F.lit(0.0).alias("v"))
    for level in range(top, -1, -1):
        size = 1 << max(level - 1, 0)
        if level == top:
            warped = base.select(*keys, "i", "j", "x1")
        else:
            warped = _sampled(moved.select(*keys, "i", "j", (F.col("i") - F.col("u")).alias("fi"), (F.col("j") - F.col("v")).alias("fj")), base, keys, n, ["x1"])
        both = warped.join(base.drop("x1").hint("merge"), [*keys, "i", "j"])
        block = lambda c: F.floor(F.col(c) / size)
        first = (F.col("i") % size == 0) & (F.col("j") % size == 0)
        coarse = both.groupBy(*keys, block("i").alias("i"), block("j").alias("j")).agg(F.avg("x1").alias("x1"), F.avg("x2").alias("x2"), F.max(F.when(first, F.col("masked")).otherwise(False)).cast("double").alias("masked"))
        tiling = _Tiling(keys, n // size, tile, halo)
        step = _solve(coarse, tiling, store, f"level-{level}", sweeps, tolerance, smoothness)
        at = base.select(*keys, "i", "j", (F.col("i") / size).alias("fi"), (F.col("j") / size).alias("fj"))
        grown = _sampled(at, step, keys, n // size, ["du", "dv"])
        scale = 2.0 ** (level - 1)
        moved = store.write(moved.join(grown.hint("merge"), [*keys, "i", "j"]).select(*keys, "i", "j", (F.col("u") + scale * F.col("du")).alias("u"), (F.col("v") + scale * F.col("dv")).alias("v")), level, "moved")
    return moved.where((F.col("i") < nx) & (F.col("j") < ny))


def warp(field: DataFrame, moved: DataFrame, keys: list[str], nx: int, ny: int) -> DataFrame:
    """``keys, i, j, value`` of the field moved by ``moved(keys, i, j, u, v)``: each cell takes what lies ``(u, v)`` before it; edges wrap.

    A cell is null where one of the cells it takes from is.
    """
    at = moved.select(*keys, "i", "j", (F.col("i") - F.col("u")).alias("fi"), (F.col("j") - F.col("v")).alias("fj"))
    i0, j0 = F.floor("fi"), F.floor("fj")
    u, v = F.col("fi") - i0, F.col("fj") - j0
    corners = F.array(*[F.struct(F.pmod(i0 + a, F.lit(nx)).alias("ci"), F.pmod(j0 + b, F.lit(ny)).alias("cj"), ((u if a else 1 - u) * (v if b else 1 - v)).alias("w")) for a in (0, 1) for b in (0, 1)])
    wanted = at.select(*keys, "i", "j", F.explode(corners).alias("k")).select(*keys, "i", "j", "k.*").where("w <> 0")
    source = field.select(*keys, F.col("i").alias("ci"), F.col("j").alias("cj"), F.nanvl(F.col("value"), F.lit(None)).alias("value"))
    found = wanted.join(source, [*keys, "ci", "cj"], "left").groupBy(*keys, "i", "j").agg(F.sum(F.col("w") * F.col("value")).alias("value"), F.count(F.when(F.col("value").isNull(), 1)).alias("missing"))
    return found.select(*keys, "i", "j", F.when(F.col("missing") == 0, F.col("value")).alias("value"))


def aligned(state: DataFrame, prior: DataFrame, post: DataFrame, moved: DataFrame, keys: list[str], grid: Grid) -> DataFrame:
    """Updated ``keys, i, j, value``: the state moved by the displacement, plus what moving the prior does not explain of the posterior.

    All have columns ``keys, i, j, value``. Where the update is not known the state keeps its value.
    """
    keys_at = [*keys, "i", "j"]
    residual = post.select(*keys_at, F.col("value").alias("post")).join(warp(prior, moved, keys, grid.nx, grid.ny).withColumnRenamed("value", "w"), keys_at).select(*keys_at, (F.col("post") - F.col("w")).alias("residual"))
    carried = warp(state, moved, keys, grid.nx, grid.ny).withColumnRenamed("value", "carried")
    out = state.select(*keys_at, F.col("value").alias("own")).join(carried, keys_at, "left").join(residual, keys_at, "left")
    return out.select(*keys_at, F.coalesce(F.col("carried") + F.col("residual"), "own").alias("value"))
