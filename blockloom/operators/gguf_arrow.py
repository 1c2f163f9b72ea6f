"""Records of the container's block types on Arrow batches: the bytes of ``gguf.records``, whole rows at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dims import FORMATS, LEVELS
from ..shipping import ship
from .blocks_arrow import PACKED_NAMES, _flat, runs, unpack_lists
from .gguf import AFFINE, K_AFFINE, K_SYMMETRIC, SYMMETRIC
from .trellis import group_scales

TRELLIS = ("Q4_K", "Q5_K")  #: types whose eight group scales can be chosen by the trellis


def _half(x: np.ndarray) -> np.ndarray:
    return x.astype(np.float16).astype(np.float64)


def _round(x: np.ndarray) -> np.ndarray:
    return np.where(x < 0, -np.floor(-x + 0.5), np.floor(x + 0.5))


def _over(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.divide(x, by, out=np.zeros(np.broadcast_shapes(x.shape, by.shape)), where=by != 0)


def _halves(x: np.ndarray) -> np.ndarray:
    return x.astype("<f2").view(np.uint8).reshape(len(x), 2)


def _nibbles(codes: np.ndarray) -> np.ndarray:
    return (codes[:, ::2] & 15 | (codes[:, 1::2] & 15) << 4).astype(np.uint8)


def _bits(codes: np.ndarray, bit: int) -> np.ndarray:
    return np.packbits((codes >> bit & 1).astype(np.uint8), axis=1, bitorder="little")


def _quads(codes: np.ndarray) -> np.ndarray:
    return sum((codes[:, k::4] & 3) << 2 * k for k in range(4)).astype(np.uint8)


def _six(s: np.ndarray, m: np.ndarray) -> np.ndarray:
    low, mid = ((x[:, :4] & 63) + (x[:, 4:] >> 4 << 6) for x in (s, m))
    return np.concatenate((low, mid, (s[:, 4:] & 15) + ((m[:, 4:] & 15) << 4)), axis=1).astype(np.uint8)


def _smooth_scales(shifted: np.ndarray, d: np.ndarray, top: int, penalty: float) -> np.ndarray:
    """Group scales for what the codes stand for: values with the minimum subtracted; what isn't above it gets code 0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        logs = np.where(shifted > 0, np.log2(shifted), np.nan)
    return group_scales(logs, np.log2(np.where(d > 0, d, 1.0)), penalty, float(np.log2(top)))


def blocks_of(v: np.ndarray, t: str, penalty: float | None = None) -> np.ndarray:
    """The bytes of each block ``v[block, element]`` of a container type.

    With a ``penalty`` the types in ``TRELLIS`` get smoothed scales; other types have one form only.
    """
    most_of = np.abs(v).max(axis=1)
    if t in SYMMETRIC:
        top, offset, low, high = SYMMETRIC[t]
        d = _half(most_of / top)
        codes = np.clip(_round(_over(v, d[:, None])), low, high).astype(np.int64) + offset
        if t == "Q8_0":
            return np.concatenate((_halves(d), codes.astype(np.int8).view(np.uint8)), axis=1)
        return np.concatenate((_halves(d), *([_bits(codes, 4)] if t == "Q5_0" else []), _nibbles(codes)), axis=1)
    if t in AFFINE:
        top = AFFINE[t]
        low, high = np.minimum(v.min(axis=1), 0), np.maximum(v.max(axis=1), 0)
        d, m = _half((high - low) / top), _half(low)
        codes = np.clip(_round(_over(v - m[:, None], d[:, None])), 0, top).astype(np.int64)
        return np.concatenate((_halves(d), _halves(m), *([_bits(codes, 4)] if t == "Q5_1" else []), _nibbles(codes)), axis=1)
    if t == "IQ4_NL":
        d = _half(most_of / 113)
        return np.concatenate((_halves(d), _nibbles(_level(_over(v, d[:, None])))), axis=1)
    size, top, most = (32, 120, 63) if t == "IQ4_XS" else (K_AFFINE.get(t) or K_SYMMETRIC[t])[:3]
    groups = v.reshape(len(v), -1, size)
    if t in K_AFFINE:
        up, down = np.maximum(groups.max(axis=2), 0), np.maximum(-groups.min(axis=2), 0)
        d, dmin = _half((up + down).max(axis=1) / (most * top)), _half(down.max(axis=1) / most)
        s = np.clip(_round(_over(up + down, top * d[:, None])), 1, most)
        m = np.clip(_round(_over(down, dmin[:, None])), 0, most)
        shifted = groups + (dmin[:, None] * m)[:, :, None]
        if penalty is not None and t in TRELLIS:
            s = _smooth_scales(shifted, d, top, penalty)
        codes = np.clip(_round(_over(shifted, (d[:, None] * s)[:, :, None])), 0, top).astype(np.int64).reshape(len(v), -1)
        s, m = s.astype(np.int64), m.astype(np.int64)
        if t == "Q2_K":
            return np.concatenate(((s + 16 * m).astype(np.uint8), _quads(codes), _halves(d), _halves(dmin)), axis=1)
        return np.concatenate((_halves(d), _halves(dmin), _six(s, m), *([_bits(codes, 4)] if t == "Q5_K" else []), _nibbles(codes)), axis=1)
    d = _half(most_of / float(most * top))
    s = np.clip(_round(_over(np.abs(groups).max(axis=2), top * d[:, None])), 1, most)
    scaled = _over(groups, (d[:, None] * s)[:, :, None]).reshape(len(v), -1)
    s = s.astype(np.int64)
    if t == "IQ4_XS":
        high = sum(s[:, k] >> 4 << 2 * k for k in range(8)).astype("<u2").view(np.uint8).reshape(len(v), 2)
        return np.concatenate((_halves(d), high, _nibbles(s), _nibbles(_level(scaled))), axis=1)
    offset = K_SYMMETRIC[t][3]
    codes = np.clip(_round(scaled), -offset, top).astype(np.int64) + offset
    if t == "Q3_K":
        return np.concatenate((_bits(codes, 2), _quads(codes), _six(s[:, :8], s[:, 8:]), _halves(d)), axis=1)
    return np.concatenate((_nibbles(codes), _quads(codes >> 4), s.astype(np.uint8), _halves(d)), axis=1)


def _level(x: np.ndarray) -> np.ndarray:
    """Index of the nearest level, ties to the higher one."""
    return np.searchsorted([(a + b) / 2 for a, b in zip(LEVELS, LEVELS[1:])], x, side="right")


def rows_of(values: np.ndarray, at: np.ndarray, t: str, penalty: float | None = None) -> list[bytes]:
    """The bytes of each row of a type."""
    if t in ("F32", "F16"):
        raw, width = values.astype("<f4" if t == "F32" else "<f2").tobytes(), 4 if t == "F32" else 2
        return [raw[width * a : width * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    size = 32 if t in SYMMETRIC or t in AFFINE else 256
    if (np.diff(at) % size).any():
        raise ValueError(f"{t} needs rows of a multiple of {size}")
    made = blocks_of(values.reshape(-1, size), t, penalty) if len(values) else np.zeros((0, 1), np.uint8)
    raw, width = made.tobytes(), made.shape[1]
    return [raw[a // size * width : b // size * width] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def records(rows: DataFrame, penalty: float | None = None) -> DataFrame:
    """(name, row, data): the bytes of each row of rows(name, row, type, values), in its own type."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = np.array(batch.column(2).to_pylist(), object)
            for t in sorted(set(types)):
                own = batch.take(pa.array(np.flatnonzero(types == t)))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(rows_of(*_flat(own.column(3)), t, penalty), pa.binary())], names=["name", "row", "data"])

    return rows.select("name", F.col("row").cast("long").alias("row"), "type", "values").mapInArrow(run, "name string, row long, data binary")


def packed_records(rows: DataFrame, format: str, penalty: float | None = None) -> DataFrame:
    """``records`` of packed rows(name, row, type, columns of ``PACKED``), decoded and made in one pass."""
    f = FORMATS[format]
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            types = np.array(batch.column(2).to_pylist(), object)
            for t in sorted(set(types)):
                same = batch.take(pa.array(np.flatnonzero(types == t)))
                for lo, hi in runs(same.column(3)):
                    own = [c.slice(lo, hi - lo) for c in same.columns]
                    made = rows_of(*unpack_lists(own[3:], f.size, f.bits), t, penalty)
                    yield pa.RecordBatch.from_arrays([own[0], own[1], pa.array(made, pa.binary())], names=["name", "row", "data"])

    return rows.select("name", F.col("row").cast("long").alias("row"), "type", *PACKED_NAMES).mapInArrow(run, "name string, row long, data binary")
