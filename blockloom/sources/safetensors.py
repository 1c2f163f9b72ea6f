"""Tensor files of the public SafeTensors layout: a length, a JSON header, raw values.

``TensorFileSource`` is a Python data source for shared mounts: it reads ranges, a
slice of rows a task, so headers cost no data and files of any size work; ``headers``
and ``tensors`` use it for paths that are mounted.  Other paths go through Spark's own
file reader, so any store that Spark knows will do (one file a row, up to 2 GB).
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.dims import FORMATS
from ..operators import blocks_arrow as BA
from ..shipping import ship

HEADER = "path string, name string, dtype string, shape array<long>, begin long, end long"
TENSOR = "path string, name string, dtype string, shape array<long>, plane long, row long, values array<double>"
BLOCKS = f"path string, name string, plane long, row long, {BA.PACKED}"


def to_floats(raw: bytes | memoryview, dtype: str) -> np.ndarray:
    """Values as doubles.  Other dtypes than the three float ones are an error."""
    if dtype == "F32":
        out = np.frombuffer(raw, "<f4")
    elif dtype == "F16":
        out = np.frombuffer(raw, "<f2")
    elif dtype == "BF16":
        out = (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
    else:
        raise ValueError(f"values of dtype {dtype} can't be converted")
    return out.astype(np.float64)


def parse_header(start: bytes) -> tuple[int, dict]:
    (size,) = struct.unpack("<Q", start[:8])
    return 8 + size, {k: v for k, v in json.loads(start[8 : 8 + size]).items() if k != "__metadata__"}


def matrix_shape(shape: list[int]) -> tuple[int, int, int]:
    """(planes, rows, cols): a vector is a column, leading dimensions count planes."""
    if len(shape) < 2:
        return 1, (shape[0] if shape else 1), 1
    return int(np.prod(shape[:-2], dtype=np.int64)), shape[-2], shape[-1]


def rows_of(path: str, name: str, info: dict, raw: bytes | memoryview) -> Iterator[tuple]:
    planes, rows, cols = matrix_shape(info["shape"])
    values = to_floats(raw, info["dtype"])
    if len(values) != planes * rows * cols:
        raise ValueError(f"{name} has {len(values)} values for shape {info['shape']}")
    if not np.isfinite(values).all():
        raise ValueError(f"{name} has values that aren't finite")
    for k, row in enumerate(values.reshape(planes * rows, cols)):
        yield path, name, info["dtype"], info["shape"], k // max(rows, 1), k % max(rows, 1), row


def files(spark: SparkSession, path: str) -> DataFrame:
    """The tensor files of a folder, not those of folders in it, or a single file."""
    ship(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.safetensors").load(path)
    if found.select("path").limit(1).count() == 0:
        raise FileNotFoundError(f"no .safetensors file in {path}")
    return found.select("path", "content")


def mounted(path: str) -> str | None:
    """The local form of a path on a shared mount, or None if only Spark can open it."""
    local = path.removeprefix("file://")
    return local if os.path.exists(local) else None


def _ranged(spark: SparkSession, path: str, **options: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(TensorFileSource)
    return spark.read.format("tensorfile").options(**options).load(path)


def headers(spark: SparkSession, path: str) -> DataFrame:
    if local := mounted(path):
        return _ranged(spark, local, headers="true")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for p, content in zip(batch["path"], batch["content"], strict=True):
                base, entries = parse_header(content)
                rows += [(p, n, e["dtype"], e["shape"], base + e["data_offsets"][0], base + e["data_offsets"][1]) for n, e in entries.items()]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HEADER.split(", ")])

    return files(spark, path).mapInPandas(run, HEADER)


def tensors(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """One row for each matrix row of each tensor (of ``names``, if given)."""
    if local := mounted(path):
        return _ranged(spark, local, **({} if names is None else {"names": json.dumps(names)}))
    wanted = None if names is None else set(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in TENSOR.split(", ")]
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                base, entries = parse_header(content)
                for n, e in entries.items():
                    if wanted is None or n in wanted:
                        a, b = e["data_offsets"]
                        yield pd.DataFrame(list(rows_of(p, n, e, memoryview(content)[base + a : base + b])), columns=columns)

    return files(spark, path).mapInPandas(run, TENSOR)


def packed(spark: SparkSession, path: str, names: list[str], format: str) -> DataFrame:
    """(path, name, plane, row, columns of ``PACKED``): the rows of ``tensors`` as blocks, made where they are read."""
    if local := mounted(path):
        return _ranged(spark, local, names=json.dumps(names), blocks=format)
    return BA.pack(tensors(spark, path, names), format, carry=("path", "name", "plane"))


def write(path: str, arrays: dict[str, np.ndarray]) -> None:
    """A small file in the same layout, for tests and exports of single matrices."""
    names = {"float32": "F32", "float16": "F16", "uint16": "BF16", "int8": "I8"}
    header, body = {}, b""
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        header[name] = {"dtype": names[str(a.dtype)], "shape": list(a.shape), "data_offsets": [len(body), len(body) + len(raw)]}
        body += raw
    text = json.dumps(header).encode()
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(text)) + text + body)


SLICE_BYTES = 4 << 20  #: of a tensor, or of several small ones, about, that one task reads
HEAD_FILES = 32  #: whose headers one task reads
BATCH_VALUES = 1 << 18  #: values of an Arrow batch, about


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Slice(InputPartition):
    """Rows ``first`` to ``stop`` of a tensor, counted over its planes, that begin at byte ``at``."""

    def __init__(self, path: str, name: str, info: dict, at: int, first: int, stop: int):
        self.path, self.name, self.info, self.at, self.first, self.stop = path, name, info, at, first, stop

    @property
    def width(self) -> int:
        """Bytes of a row."""
        begin, end = self.info.get("data_offsets", (0, 0))
        planes, rows, _ = matrix_shape(self.info.get("shape", []))
        return (end - begin) // (planes * rows) if planes * rows else 0


def _header_of(path: str) -> tuple[int, dict]:
    with open(path, "rb") as f:
        start = f.read(8)
        (size,) = struct.unpack("<Q", start)
        return parse_header(start + f.read(size))


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.only_headers = str(options.get("headers", "false")).lower() == "true"
        self.blocks = options.get("blocks")
        names = options.get("names")
        self.names = None if not names else set(json.loads(names) if names.startswith("[") else names.split(","))

    def partitions(self) -> list[InputPartition]:
        if os.path.isdir(self.path):
            found = sorted(os.path.join(self.path, n) for n in os.listdir(self.path) if n.endswith(".safetensors"))
        else:
            found = [self.path] if self.path.endswith(".safetensors") else []
        if not found:
            raise FileNotFoundError(f"no .safetensors file in {self.path}")
        if self.only_headers:
            return [_File(p) for p in found]
        slices = []
        for path in found:
            base, entries = _header_of(path)
            for name, e in entries.items():
                if self.names is not None and name not in self.names:
                    continue
                planes, rows, cols = matrix_shape(e["shape"])
                begin, end = e["data_offsets"]
                total = planes * rows
                if total and (end - begin) % total:
                    raise ValueError(f"{name} has {end - begin} bytes for shape {e['shape']}")
                width = (end - begin) // total if total else 0
                step = max(1, SLICE_BYTES // max(width, 1))
                slices += [_Slice(path, name, e, base + begin + k * width, k, min(k + step, total)) for k in range(0, total, step)]
        return slices or [_Slice(found[0], "", {}, 0, 0, 0)]

    def read(self, partition: InputPartition) -> Iterator:
        if self.only_headers:
            base, entries = _header_of(partition.path)
            for name, e in entries.items():
                yield partition.path, name, e["dtype"], e["shape"], base + e["data_offsets"][0], base + e["data_offsets"][1]
            return
        yield from _batches(partition, self.blocks)


class _Group(InputPartition):
    """Partitions that one task reads, in their order."""

    def __init__(self, parts: list[InputPartition]):
        self.parts = parts


class _Grouped(_Reader):
    """The same rows with a task for many headers and for about ``SLICE_BYTES`` of small tensors, so a model of many small ones makes few tasks and files."""

    def partitions(self) -> list[InputPartition]:
        found = super().partitions()
        if self.only_headers:
            return [_Group(found[k : k + HEAD_FILES]) for k in range(0, len(found), HEAD_FILES)]
        groups, held = [], 0
        for s in found:
            size = (s.stop - s.first) * s.width
            if not groups or held + size > SLICE_BYTES:
                groups.append([])
                held = 0
            groups[-1].append(s)
            held += size
        return [_Group(g) for g in groups]

    def read(self, partition: InputPartition) -> Iterator:
        for part in partition.parts:
            yield from super().read(part)


def _batches(s: _Slice, blocks: str | None = None) -> Iterator[pa.RecordBatch]:
    if s.stop == s.first:
        return
    _, rows, cols = matrix_shape(s.info["shape"])
    width = s.width
    step = max(1, BATCH_VALUES // max(cols, 1))
    with open(s.path, "rb") as f:
        f.seek(s.at)
        for first in range(s.first, s.stop, step):
            n = min(step, s.stop - first)
            values = to_floats(f.read(n * width), s.info["dtype"])
            if len(values) != n * cols:
                raise ValueError(f"{s.name} has {len(values)} values in {n} rows of {cols}")
            if not np.isfinite(values).all():
                raise ValueError(f"{s.name} has values that aren't finite")
            at = np.arange(first, first + n)
            if blocks:
                made = BA.pack_lists(values, np.arange(n + 1) * cols, FORMATS[blocks].size, FORMATS[blocks].bits)
                fixed = [pa.array([x] * n, pa.string()) for x in (s.path, s.name)]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(at // rows, pa.int64()), pa.array(at % rows, pa.int64()), *made], names=[c.split()[0] for c in BLOCKS.split(", ")])
                continue
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * cols, cols) if cols else np.zeros(n + 1), pa.int32()), pa.array(values))
            shape = pa.array([s.info["shape"]] * n, pa.list_(pa.int64()))
            fixed = [pa.array([x] * n, pa.string()) for x in (s.path, s.name, s.info["dtype"])]
            yield pa.RecordBatch.from_arrays([*fixed, shape, pa.array(at // rows, pa.int64()), pa.array(at % rows, pa.int64()), lists], names=[c.split()[0] for c in TENSOR.split(", ")])


class TensorFileSource(DataSource):
    """``spark.read.format("tensorfile").load(path)``; options ``headers``, ``names`` and ``blocks`` (a format)."""

    @classmethod
    def name(cls) -> str:
        return "tensorfile"

    def schema(self) -> str:
        if str(self.options.get("headers", "false")).lower() == "true":
            return HEADER
        return BLOCKS if self.options.get("blocks") else TENSOR

    def reader(self, schema) -> DataSourceReader:
        return _Grouped(dict(self.options))
