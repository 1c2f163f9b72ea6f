"""Binary containers: block matrices with a small header, and quantized tensors in the public GGUF layout."""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dims import FORMATS, GGUF_TYPES
from ..operators.blocks import bytes_hex
from ..shipping import ship

MAGIC = b"GMAT"  #: fixed value: the first bytes of a block matrix file


def block_header(format: str, rows: int, cols: int, metadata: dict | None = None) -> bytes:
    head = MAGIC + struct.pack("<HBQQ", 1 if metadata is None else 2, FORMATS[format].id, rows, cols)
    if metadata is None:
        return head
    text = json.dumps(metadata, sort_keys=True).encode()
    return head + struct.pack("<I", len(text)) + text


def read_block_header(data: bytes) -> tuple[str, int, int, dict | None, int]:
    """(format, rows, cols, metadata, where the blocks begin)."""
    if data[:4] != MAGIC:
        raise ValueError("not a block matrix")
    version, kind, rows, cols = struct.unpack("<HBQQ", data[4:23])
    if version not in (1, 2) or kind > 7:
        raise ValueError(f"version {version}, format {kind} can't be read")
    name = next(f.name for f in FORMATS.values() if f.id == kind)
    if version == 1:
        return name, rows, cols, None, 23
    (size,) = struct.unpack("<I", data[23:27])
    return name, rows, cols, json.loads(data[27 : 27 + size]), 27 + size


def pack_matrix(blocks: DataFrame, format: str, rows: int, cols: int, metadata: dict | None = None) -> bytes:
    """One matrix as a file's bytes.  For exchange with other tools; the engine itself keeps Parquet."""
    parts = bytes_hex(blocks, format).orderBy("row_group", "block").select("bytes").toLocalIterator()
    return block_header(format, rows, cols, metadata) + b"".join(bytes.fromhex(r[0]) for r in parts)


def unpack_blocks(data: bytes) -> Iterator[tuple[int, int, float, list[dict]]]:
    """(row_group, block, scale_log, rows) from a file's bytes."""
    import numpy as np

    format, rows, cols, _, at = read_block_header(data)
    f = FORMATS[format]
    m, parts = f.mask_bytes, 2 if f.dual else 1
    number = lambda a: int.from_bytes(data[a : a + m], "little")
    for group in range(-(-rows // parts)):
        for block in range(-(-cols // f.size)):
            zero = [number(at + k * m) for k in range(parts)]
            at += parts * m
            scale, made = 0.0, [{"zero_map": z, "signs": 0, "octave_shift": 0, "codes": [0] * f.size} for z in zero]
            if any(zero):
                scale = float(np.frombuffer(data[at : at + 2], "<f2")[0])
                at += 2
                for part in made:
                    part["signs"], part["octave_shift"] = number(at), number(at + m)
                    raw = data[at + 2 * m : at + 2 * m + f.magnitude_bytes]
                    part["codes"] = list(raw) if f.bits == 8 else [b >> s & 15 for b in raw for s in (0, 4)]
                    at += 2 * m + f.magnitude_bytes
            yield group, block, scale, made


BLOCKS = "row_group long, block int, scale_log double, rows array<struct<zero_map: int, signs: int, octave_shift: int, codes: array<int>>>"


def read_matrices(spark, path: str) -> DataFrame:
    """(path, format, row_group, block, scale_log, rows) of the block matrix files at ``path``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                name = read_block_header(content)[0]
                yield pd.DataFrame([(p, name, *b) for b in unpack_blocks(content)], columns=["path", "format", "row_group", "block", "scale_log", "rows"])

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, f"path string, format string, {BLOCKS}")


# ---- the quantized container: public layout, version 3 ---------------------------------

#: Fixed values of the public layout: type numbers and value kinds.
TYPE_IDS = {"F32": 0, "F16": 1, "Q4_0": 2, "Q4_1": 3, "Q5_0": 6, "Q5_1": 7, "Q8_0": 8, "Q2_K": 10, "Q3_K": 11, "Q4_K": 12, "Q5_K": 13, "Q6_K": 14, "IQ4_NL": 20, "IQ4_XS": 23}
ALIGN = 32


def _text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack("<Q", len(raw)) + raw


def _value(v) -> bytes:
    if isinstance(v, bool):
        return struct.pack("<IB", 7, v)
    if isinstance(v, int):
        return struct.pack("<II", 4, v)
    if isinstance(v, float):
        return struct.pack("<If", 6, v)
    if isinstance(v, str):
        return struct.pack("<I", 8) + _text(v)
    items = [_value(x) for x in v]
    kind = items[0][:4] if items else struct.pack("<I", 8)
    return struct.pack("<I", 9) + kind + struct.pack("<Q", len(items)) + b"".join(x[4:] for x in items)


def container_head(metadata: dict, tensors: list[tuple[str, list[int], str, int]]) -> tuple[bytes, list[int], int]:
    """(head, place of each tensor in the file, size of the file) for (name, dims with columns first, type, bytes)."""
    head = b"GGUF" + struct.pack("<IQQ", 3, len(tensors), len(metadata))
    head += b"".join(_text(k) + _value(v) for k, v in metadata.items())
    at, places = 0, []
    for name, dims, kind, size in tensors:
        head += _text(name) + struct.pack("<I", len(dims)) + b"".join(struct.pack("<Q", d) for d in dims) + struct.pack("<IQ", TYPE_IDS[kind], at)
        places.append(at)
        at += -(-size // ALIGN) * ALIGN
    head += b"\0" * (-len(head) % ALIGN)
    return head, [len(head) + p for p in places], len(head) + at


def write_shards(plan: DataFrame, records: DataFrame, folder: str, stem: str, metadata: dict) -> DataFrame:
    """One container file for each shard in ``folder``, which all executors must share; gives (shard, path, tensors, size).

    plan(shard, ordinal, name, rows, cols, type, bytes) is the catalog of one model; it
    says where each record lies, so heads are written first and every task then writes
    its records in their places.  Nothing is gathered by shard, and a task that runs twice
    writes the same bytes.  records(name, row, data), the bytes of each row.
    """
    tensors = plan.select("shard", "ordinal", "name", "rows", "cols", "type", "bytes").orderBy("shard", "ordinal").collect()
    places: dict[str, tuple[str, int, int]] = {}
    made, want = [], {}
    for shard in sorted({t.shard for t in tensors}):
        own = [t for t in tensors if t.shard == shard]
        head, at, size = container_head(metadata, [(t.name, [t.cols, t.rows], t.type, t.bytes) for t in own])
        path = os.path.join(folder, f"{stem}-{shard + 1:05d}.gguf")
        with open(path, "wb") as f:
            f.write(head)
            f.truncate(size)
        for t, begin in zip(own, at, strict=True):
            width = t.bytes // t.rows if t.rows else 0
            places[t.name] = (path, begin, width)
        made.append((shard, path, len(own), size))
        want[path] = sum(t.bytes for t in own)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            written: dict[str, int] = {}
            parts: dict[str, list[tuple[int, bytes]]] = {}
            for name, row, data in zip(batch["name"], batch["row"], batch["data"], strict=True):
                path, begin, width = places[name]
                if len(data) != width:
                    raise ValueError(f"row {row} of {name} has {len(data)} bytes instead of {width}")
                parts.setdefault(path, []).append((begin + row * width, bytes(data)))
            for path, found in parts.items():
                found.sort()
                file = os.open(path, os.O_WRONLY)
                try:
                    at = 0
                    while at < len(found):
                        stop, end = at, found[at][0]
                        while stop < len(found) and found[stop][0] == end:
                            end += len(found[stop][1])
                            stop += 1
                        run = b"".join(x for _, x in found[at:stop])
                        while run:
                            n = os.pwrite(file, run, end - len(run))
                            run = run[n:]
                        at = stop
                    os.fsync(file)
                finally:
                    os.close(file)
                written[path] = sum(len(x) for _, x in found)
            yield pd.DataFrame({"path": list(written), "n": list(written.values())})

    spark = records.sparkSession
    ship(spark)
    sent = records.select("name", "row", "data").mapInPandas(write, "path string, n long")
    have = {r.path: r.n for r in sent.groupBy("path").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    if any(have.get(p, 0) != n for p, n in want.items()):
        raise ValueError(f"shards hold {have} bytes of records instead of {want}")
    return spark.createDataFrame(made, "shard int, path string, tensors int, size long")


def _read_value(f, kind: int):
    if kind == 8:
        return f.read(struct.unpack("<Q", f.read(8))[0]).decode()
    if kind == 9:
        inner, n = struct.unpack("<IQ", f.read(12))
        return [_read_value(f, inner) for _ in range(n)]
    form = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}[kind]
    return struct.unpack(f"<{form}", f.read(struct.calcsize(f"<{form}")))[0]


def read_container_head(path: str) -> tuple[dict, list[tuple[str, int, int, str, int, int]]]:
    """Metadata and (name, rows, cols, type, place of its data in the file, bytes) of each tensor."""
    names = {v: k for k, v in TYPE_IDS.items()}
    blocks = {(t[:-2] if t[-2:] in ("_S", "_M", "_L") and not t.startswith("IQ") else t): v for t, v in GGUF_TYPES.items()}
    with open(path, "rb") as f:
        if f.read(4) != b"GGUF":
            raise ValueError(f"{path} is no container")
        version, n_tensors, n_values = struct.unpack("<IQQ", f.read(20))
        if version != 3:
            raise ValueError(f"version {version} can't be read")
        metadata = {}
        for _ in range(n_values):
            key = _read_value(f, 8)
            metadata[key] = _read_value(f, struct.unpack("<I", f.read(4))[0])
        found = []
        for _ in range(n_tensors):
            name = _read_value(f, 8)
            (rank,) = struct.unpack("<I", f.read(4))
            dims = struct.unpack(f"<{rank}Q", f.read(8 * rank))
            kind, at = struct.unpack("<IQ", f.read(12))
            found.append((name, dims[1] if rank > 1 else 1, dims[0], names[kind], at))
        base = -(-f.tell() // ALIGN) * ALIGN
    out = []
    for name, rows, cols, kind, at in found:
        size, held = blocks[kind]
        out.append((name, rows, cols, kind, base + at, rows * -(-cols // size) * held))
    return metadata, out


def container_tensors(spark, folder: str) -> DataFrame:
    """(path, shard, name, rows, cols, type, place, bytes, inside) of the container files in a shared folder, heads only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                size, (_, tensors) = os.path.getsize(path), read_container_head(path)
                rows = [(path, int(path[-10:-5]) - 1, *t, t[4] + t[5] <= size) for t in tensors]
                yield pd.DataFrame(rows, columns=["path", "shard", "name", "rows", "cols", "type", "place", "bytes", "inside"])

    ship(spark)
    paths = sorted(os.path.join(folder, n) for n in os.listdir(folder) if n.endswith(".gguf"))
    return spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(run, "path string, shard int, name string, rows long, cols long, type string, place long, bytes long, inside boolean")
