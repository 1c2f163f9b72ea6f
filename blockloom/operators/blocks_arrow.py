"""The single-row block codec on Arrow batches: same blocks as ``blocks.encode``, a batch of rows at once in numpy.

Higher-order functions are interpreted element by element; on whole models this
path is many times faster, so import and export use it.

A stored model has one packed row for each matrix row: its blocks' scales (half
floats), masks and codes (a byte, or half of one, each) as bytes, and the counts that
analysis needs.  ``pack`` makes such rows, ``unpack`` gives the values without a
shuffle, and ``relational`` gives the same relation of blocks that ``encode`` makes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import SNAP, shift_of
from ..functions.dims import FORMATS
from ..shipping import ship

PARTS = "array<struct<zero_map: int, signs: int, octave_shift: int, codes: array<int>>>"


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the n + 1 places where lists begin."""
    at = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]], at - at[0]


def encode_lists(values: np.ndarray, at: np.ndarray, size: int, bits: int):
    """(row, block, scale_log, zero_map, signs, octave_shift, codes, code places) of lists of values cut into blocks."""
    lengths = np.diff(at)
    blocks = -(-lengths // size)
    first = np.append(0, np.cumsum(blocks))
    n = int(first[-1])
    where = np.repeat(first[:-1] * size - at[:-1], lengths) + np.arange(len(values))
    cells = np.zeros(n * size)
    cells[where] = values
    cells = cells.reshape(n, size)
    there = cells != 0
    logs = np.full(cells.shape, np.inf)
    np.log2(np.abs(cells), out=logs, where=there)
    base = logs.min(axis=1) if n else np.zeros(0)
    some = np.isfinite(base)
    base = np.where(some, base, 0.0)
    offset = np.where(there, logs - base[:, None], 0.0)
    shift = shift_of(bits)
    shifted = there & (offset >= shift - SNAP)
    step, top = (128.0, 2 - 1 / 128) if bits == 8 else (16.0, 15 / 16)
    codes = np.floor(np.clip(offset - shift * shifted, 0, top) * step + SNAP).astype(np.int32)
    weights = 1 << np.arange(size)
    maps = [(m * weights).sum(axis=1).astype(np.int32) for m in (there, cells < 0, shifted)]
    row = np.repeat(np.arange(len(lengths)), blocks)
    block = np.arange(n) - first[:-1][row]
    held = np.minimum(size, lengths[row] - block * size)
    scale = np.where(some, base, 0.0).astype(np.float16).astype(np.float64)
    return row, block, scale, *maps, codes.reshape(-1)[where], np.append(0, np.cumsum(held))


def _block_batch(kept: list[pa.Array], names: list[str], block, scale, zero, signs, octave, codes, places) -> pa.RecordBatch:
    """A batch with one row a block, after the columns ``kept``."""
    part = pa.StructArray.from_arrays([pa.array(zero, pa.int32()), pa.array(signs, pa.int32()), pa.array(octave, pa.int32()), pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(codes, pa.int32()))], names=["zero_map", "signs", "octave_shift", "codes"])
    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1), pa.int32()), part)
    return pa.RecordBatch.from_arrays([*kept, pa.array(block, pa.int32()), pa.array(scale), rows], names=[*names, "block", "scale_log", "rows"])


def encode(rows: DataFrame, format: str, row: str = "row", values: str = "values", carry: tuple[str, ...] = ()) -> DataFrame:
    """(row_group, *carry, block, scale_log, rows) in a single-row format."""
    f = FORMATS[format]
    if f.dual:
        raise ValueError("dual-row formats pair rows; use blocks.encode")
    ship(rows.sparkSession)
    narrow = rows.select(F.col(row).cast("long").alias("row_group"), *carry, F.col(values).alias("values"))
    names = narrow.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, block, scale, zero, signs, octave, codes, places = encode_lists(*_flat(batch.column(batch.num_columns - 1)), f.size, f.bits)
            own = pa.array(row)
            yield _block_batch([batch.column(k).take(own) for k in range(batch.num_columns - 1)], names, block, scale, zero, signs, octave, codes, places)

    schema = T.StructType([*narrow.schema.fields[:-1], *T.StructType.fromDDL(f"block int, scale_log double, rows {PARTS}").fields])
    return narrow.mapInArrow(run, schema)


def decode_parts(scale: np.ndarray, zero: np.ndarray, signs: np.ndarray, octave: np.ndarray, codes: np.ndarray, places: np.ndarray, bits: int) -> np.ndarray:
    """Values of blocks, one after the other, as many as they have codes."""
    held = np.diff(places)
    own = np.repeat(np.arange(len(held)), held)
    bit = np.arange(len(codes)) - places[:-1][own]
    of = lambda m: (m[own] >> bit & 1).astype(bool)
    logs = scale[own] + codes / (128.0 if bits == 8 else 16.0) + shift_of(bits) * of(octave)
    return np.where(of(zero), np.where(of(signs), -1.0, 1.0) * np.exp2(logs), 0.0)


def decode(blocks: DataFrame, format: str, keys: tuple[str, ...]) -> DataFrame:
    """(*keys, row, values) of single-row blocks; one shuffle by keys and row."""
    f = FORMATS[format]
    ship(blocks.sparkSession)
    part = F.col("rows")[0]
    flat = blocks.select(*keys, F.col("row_group").alias("row"), F.struct("block", "scale_log", part["zero_map"].alias("zero_map"), part["signs"].alias("signs"), part["octave_shift"].alias("octave_shift"), part["codes"].alias("codes")).alias("b"))
    grouped = flat.groupBy(*keys, "row").agg(F.sort_array(F.collect_list("b")).alias("b"))
    names = [*keys, "row", "values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column(batch.num_columns - 1)
            at = lists.offsets.to_numpy().astype(np.int64)
            inner = lists.values.slice(at[0], at[-1] - at[0])
            _, scale, zero, signs, octave, codes = (c if k == 5 else c.to_numpy() for k, c in enumerate(inner.flatten()))
            flat_codes, places = _flat(codes)
            values = decode_parts(scale, zero, signs, octave, flat_codes, places, f.bits)
            begins = places[at - at[0]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.array(values))], names=names)

    schema = T.StructType([*grouped.schema.fields[:-1], T.StructField("values", T.ArrayType(T.DoubleType()))])
    return grouped.mapInArrow(run, schema)


PACKED = "n int, nnz long, shifted long, scales binary, zero_maps binary, signs binary, octave_shifts binary, codes binary"
PACKED_NAMES = [c.split()[0] for c in PACKED.split(", ")]
RUN_VALUES = 1 << 18  #: values that are decoded at once, about; a longer row stands alone


def _binary(flat: np.ndarray, at: np.ndarray) -> pa.Array:
    """A binary column of the bytes of ``flat`` between the places ``at``."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(flat))])


def _bytes(column: pa.Array) -> np.ndarray:
    """All bytes of a binary column, one value after the other."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)


def _mask_type(size: int) -> np.dtype:
    return np.dtype("<u1" if size <= 8 else "<u2")


def pack_lists(values: np.ndarray, at: np.ndarray, size: int, bits: int) -> list[pa.Array]:
    """The columns of ``PACKED`` for lists of values."""
    _, _, scale, zero, signs, octave, codes, _ = encode_lists(values, at, size, bits)
    lengths = np.diff(at)
    first = np.append(0, np.cumsum(-(-lengths // size)))

    def ones(masks: np.ndarray) -> pa.Array:
        total = np.append(0, np.cumsum(np.bitwise_count(masks), dtype=np.int64))
        return pa.array(np.diff(total[first]))

    kind = _mask_type(size)
    masks = [_binary(m.astype(kind), first * kind.itemsize) for m in (zero, signs, octave)]
    codes, ends = codes.astype(np.uint8), at
    if bits == 4:  # two codes a byte, the first one low; each list begins with a byte
        ends = np.append(0, np.cumsum((lengths + 1) // 2))
        pairs = np.zeros(2 * ends[-1], np.uint8)
        pairs[np.repeat(2 * ends[:-1] - at[:-1], lengths) + np.arange(len(codes))] = codes
        codes = pairs[::2] | pairs[1::2] << 4
    return [pa.array(lengths, pa.int32()), ones(zero), ones(octave & zero), _binary(scale.astype("<f2"), first * 2), *masks, _binary(codes, ends)]


def _parts(columns: list[pa.Array], size: int, bits: int):
    """(lists' places, row, block, scale, zero_map, signs, octave_shift, codes, code places) of columns of ``PACKED``."""
    lengths = columns[0].to_numpy().astype(np.int64)
    blocks = -(-lengths // size)
    row = np.repeat(np.arange(len(lengths)), blocks)
    block = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    places = np.append(0, np.cumsum(np.minimum(size, lengths[row] - block * size)))
    scale = _bytes(columns[3]).view("<f2").astype(np.float64)
    masks = [_bytes(c).view(_mask_type(size)).astype(np.int32) for c in columns[4:7]]
    codes, at = _bytes(columns[7]), np.append(0, np.cumsum(lengths))
    if bits == 4:
        pairs = np.stack((codes & 15, codes >> 4), axis=1).reshape(-1)
        begins = np.cumsum((lengths + 1) // 2 * 2) - (lengths + 1) // 2 * 2
        codes = pairs[np.repeat(begins - at[:-1], lengths) + np.arange(at[-1])]
    return at, row, block, scale, *masks, codes, places


def unpack_lists(columns: list[pa.Array], size: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and the n + 1 places where lists begin."""
    at, _, _, *parts = _parts(columns, size, bits)
    return decode_parts(*parts, bits), at


def runs(lengths: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of lists that hold about ``RUN_VALUES`` values."""
    total, start = np.append(0, np.cumsum(lengths.to_numpy(), dtype=np.int64)), 0
    while start < len(lengths):
        end = max(start + 1, int(np.searchsorted(total, total[start] + RUN_VALUES, "right")) - 1)
        yield start, end
        start = end


def pack(rows: DataFrame, format: str, row: str = "row", values: str = "values", carry: tuple[str, ...] = ()) -> DataFrame:
    """(*carry, row, columns of ``PACKED``) in a single-row format, one row for each."""
    f = FORMATS[format]
    if f.dual:
        raise ValueError("dual-row formats pair rows; use blocks.encode")
    ship(rows.sparkSession)
    narrow = rows.select(*carry, F.col(row).cast("long").alias("row"), F.col(values).alias("values"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *pack_lists(*_flat(batch.columns[-1]), f.size, f.bits)], names=[*batch.schema.names[:-1], *PACKED_NAMES])

    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[:-1], *T.StructType.fromDDL(PACKED).fields]))


def unpack(packed: DataFrame, format: str, keys: tuple[str, ...]) -> DataFrame:
    """(*keys, row, values) of packed rows; nothing is shuffled."""
    f = FORMATS[format]
    ship(packed.sparkSession)
    narrow = packed.select(*keys, "row", *PACKED_NAMES)
    kept = len(keys) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in runs(batch.column(kept)):
                own = [c.slice(lo, hi - lo) for c in batch.columns]
                values, at = unpack_lists(own[kept:], f.size, f.bits)
                yield pa.RecordBatch.from_arrays([*own[:kept], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values))], names=[*batch.schema.names[:kept], "values"])

    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[:kept], T.StructField("values", T.ArrayType(T.DoubleType()))]))


def relational(packed: DataFrame, format: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(row_group, *carry, block, scale_log, rows): the blocks of packed rows, one row a block."""
    f = FORMATS[format]
    ship(packed.sparkSession)
    narrow = packed.select(F.col("row").alias("row_group"), *carry, *PACKED_NAMES)
    kept = len(carry) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in runs(batch.column(kept)):
                own = [c.slice(lo, hi - lo) for c in batch.columns]
                _, row, block, *parts = _parts(own[kept:], f.size, f.bits)
                yield _block_batch([c.take(pa.array(row)) for c in own[:kept]], batch.schema.names[:kept], block, *parts)

    return narrow.mapInArrow(run, T.StructType([*narrow.schema.fields[:kept], *T.StructType.fromDDL(f"block int, scale_log double, rows {PARTS}").fields]))
