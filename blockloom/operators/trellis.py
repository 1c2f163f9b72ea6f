"""Scale and state selection by dynamic programming; vectorised over blocks in Arrow batches.

These carry state from group to group, which no built-in expression does.  A
batch holds many blocks; the programs run over all of them at once in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

SCALES, CAP, LAMBDA = 64, 3.91, 0.3
STATES, SMOOTH, COUPLING, KEPT = 16, 0.3, 0.2, 8


def smooth_path(costs: np.ndarray, penalty: float) -> np.ndarray:
    """Cheapest path through ``costs[block, step, state]`` with ``penalty`` for each state moved; first minimum wins."""
    n, steps, states = costs.shape
    index = np.arange(states)
    total, back = costs[:, 0].copy(), np.zeros((n, steps, states), np.int64)
    for k in range(1, steps):
        # min over p of total[p] + penalty * |s - p|, from the left and from the right
        rising, falling = total - penalty * index, total + penalty * index
        left = np.minimum.accumulate(rising, axis=1)
        right = np.minimum.accumulate(falling[:, ::-1], axis=1)[:, ::-1]
        at_left = _first_at(rising, left)
        at_right = states - 1 - _first_at(falling[:, ::-1], right[:, ::-1], last=True)[:, ::-1]
        a, b = left + penalty * index, right - penalty * index
        take_left = a <= b
        back[:, k] = np.where(take_left, at_left, at_right)
        total = costs[:, k] + np.where(take_left, a, b)
    path = np.empty((n, steps), np.int64)
    path[:, -1] = total.argmin(axis=1)
    rows = np.arange(n)
    for k in range(steps - 1, 0, -1):
        path[:, k - 1] = back[rows, k, path[:, k]]
    return path


def _first_at(values: np.ndarray, running: np.ndarray, last: bool = False) -> np.ndarray:
    """Where each running minimum was met: the first place, or the last one."""
    new = np.empty(values.shape, bool)
    new[:, 0] = True
    new[:, 1:] = (values[:, 1:] <= running[:, :-1]) if last else (values[:, 1:] < running[:, :-1])
    return np.maximum.accumulate(np.where(new, np.arange(values.shape[1]), 0), axis=1)


SCALE_BLOCKS, PATH_BLOCKS = 16, 512  #: super-blocks whose scales are tried, and whose paths are made, at once; for the caches


def group_scales(logs: np.ndarray, log_d: np.ndarray, penalty: float = LAMBDA, cap: float = CAP) -> np.ndarray:
    """Scale of each of a super-block's groups.  logs[block, group, element], NaN where absent; ``cap``: log2 of the greatest code."""
    log_s = np.log2(np.arange(1, SCALES))[:, None]  # scale 0 is never taken
    out = np.empty(logs.shape[:2], np.int64)
    for first in range(0, len(logs), PATH_BLOCKS):
        stop = min(first + PATH_BLOCKS, len(logs))
        err = np.full((stop - first, logs.shape[1], SCALES), np.inf)
        for at in range(first, stop, SCALE_BLOCKS):
            own = slice(at, min(at + SCALE_BLOCKS, stop))
            y = (logs[own] - log_d[own, None, None])[:, :, None, :]
            none = np.isnan(y)
            below = log_s - np.where(none, np.inf, y)
            above = np.where(none, -np.inf, y) - cap - log_s
            both = np.maximum(below, 0, out=below)
            both += np.maximum(above, 0, out=above)
            err[at - first : at - first + len(y), :, 1:] = both.sum(axis=3)
        out[first:stop] = smooth_path(err, penalty)
    return out


def superblock_scales(rows: DataFrame, row: str = "row", values: str = "values", penalty: float = LAMBDA) -> DataFrame:
    """(row, sb, scales): smoothed scales of the eight groups of each super-block of 256."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            v = np.stack(batch["v"].to_numpy()).astype(float)
            with np.errstate(divide="ignore"):
                logs = np.where(v != 0, np.log2(np.abs(v)), np.nan).reshape(len(v), 8, 32)
            top = np.abs(v).max(axis=1)
            log_d = np.log2(np.where(top > 0, np.float16(top / 63).astype(float), 1.0))
            yield pd.DataFrame({"row": batch["row"], "sb": batch["sb"], "scales": list(group_scales(logs, log_d, penalty).astype(np.int32))})

    from ..functions.codec import slices

    ship(rows.sparkSession)
    cut = rows.select(F.col(row).cast("long").alias("row"), F.posexplode(slices(F.col(values), 256)).alias("sb", "v")).where(F.size("v") == 256)
    return cut.mapInPandas(run, "row long, sb int, scales array<int>")


def single_states(v: np.ndarray, penalty: float = SMOOTH) -> np.ndarray:
    """States 0 to 15 of each element of blocks v[block, element]."""
    top = np.abs(v).max(axis=1, keepdims=True)
    offset = np.divide(np.abs(v), top, out=np.zeros_like(v), where=top > 0)
    costs = (offset[:, :, None] - np.arange(STATES) / (STATES - 1)) ** 2
    return smooth_path(costs, penalty / (STATES - 1))


def trellis_single(rows: DataFrame, row: str = "row", values: str = "values", size: int = 16) -> DataFrame:
    """(row, block, scale, signs, states) of blocks of ``size``; signs are a bit mask."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            v = np.zeros((len(batch), size))
            for k, x in enumerate(batch["v"]):
                v[k, : len(x)] = x
            states = single_states(v)
            signs = ((v < 0) * (1 << np.arange(size))).sum(axis=1)
            yield pd.DataFrame({"row": batch["row"], "block": batch["block"], "scale": np.abs(v).max(axis=1) / (STATES - 1), "signs": signs.astype(np.int32), "states": [s[: len(x)].astype(np.int32) for s, x in zip(states, batch["v"], strict=True)]})

    from ..functions.codec import slices

    ship(rows.sparkSession)
    cut = rows.select(F.col(row).cast("long").alias("row"), F.posexplode(slices(F.col(values), size)).alias("block", "v"))
    return cut.mapInPandas(run, "row long, block int, scale double, signs int, states array<int>")


def top_states(offset: np.ndarray, k: int = KEPT) -> np.ndarray:
    """The k states nearest to each offset, nearest first, ties to the lower one."""
    err = (offset[..., None] - np.arange(STATES) / (STATES - 1)) ** 2
    return np.argsort(err, axis=-1, kind="stable")[..., :k]


def dual_states(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coupled states of two rows of blocks, a[block, element] and b, from the eight nearest of each element."""
    n, steps = a.shape
    ka, kb = top_states(a), top_states(b)
    grid = np.arange(STATES) / (STATES - 1)
    pairs_a, pairs_b = np.repeat(ka, KEPT, axis=2), np.tile(kb, (1, 1, KEPT))  # block, step, pair of states
    total, back = None, []
    for k in range(steps):
        ga, gb = grid[pairs_a[:, k]], grid[pairs_b[:, k]]
        cost = (a[:, k, None] - ga) ** 2 + (b[:, k, None] - gb) ** 2 + COUPLING * np.abs(ga - gb)
        if total is not None:
            move = SMOOTH * (np.abs(ga[:, :, None] - pa[:, None, :]) + np.abs(gb[:, :, None] - pb[:, None, :])) + total[:, None, :]
            best = move.argmin(axis=2)
            back.append(best)
            cost = cost + np.take_along_axis(move, best[:, :, None], axis=2)[:, :, 0]
        total, pa, pb = cost, ga, gb
    rows, at = np.arange(n), total.argmin(axis=1)
    first, second = np.empty((n, steps), np.int64), np.empty((n, steps), np.int64)
    for k in range(steps - 1, -1, -1):
        first[:, k], second[:, k] = pairs_a[rows, k, at], pairs_b[rows, k, at]
        if k:
            at = back[k - 1][rows, at]
    return first, second


DUAL_BLOCKS = 256  #: blocks that the coupled program takes at once: 64 x 64 moves of each


def trellis_dual(rows: DataFrame, threshold: float = 1.0, row: str = "row", values: str = "values", size: int = 16) -> DataFrame:
    """(pair, block, scale, states_a, states_b, redundant): row pairs share a scale; an odd last row is paired with itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for _, own in batch.groupby(batch["x"].map(len)):  # a block is shorter only at the end of a row
                for at in range(0, len(own), DUAL_BLOCKS):
                    part = own.iloc[at : at + DUAL_BLOCKS]
                    x, y = np.abs(np.stack(part["x"].to_list())), np.abs(np.stack(part["y"].to_list()))
                    scale = np.maximum(np.minimum(x.max(axis=1), y.max(axis=1)) / (STATES - 1), 1e-6)
                    unit = scale[:, None] * (STATES - 1)
                    a, b = dual_states(np.clip(x / unit, 0, 1), np.clip(y / unit, 0, 1))
                    redundant = np.abs(a - b).mean(axis=1) <= threshold
                    out += list(zip(part["pair"], part["block"], scale, a.astype(np.int32), b.astype(np.int32), redundant.astype(int), strict=True))
            yield pd.DataFrame(out, columns=["pair", "block", "scale", "states_a", "states_b", "redundant"])

    from ..functions.codec import slices

    ship(rows.sparkSession)
    pairs = rows.groupBy(F.floor(F.col(row) / 2).cast("long").alias("pair")).agg(F.max(F.when(F.col(row) % 2 == 0, F.col(values))).alias("a"), F.max(F.when(F.col(row) % 2 == 1, F.col(values))).alias("b"))
    pairs = pairs.withColumn("a", F.coalesce("a", "b")).withColumn("b", F.coalesce("b", "a"))
    cut = pairs.select("pair", F.posexplode(F.arrays_zip(slices(F.col("a"), size).alias("x"), slices(F.col("b"), size).alias("y"))).alias("block", "z")).select("pair", "block", "z.x", "z.y")
    return cut.mapInPandas(run, "pair long, block int, scale double, states_a array<int>, states_b array<int>, redundant int")
