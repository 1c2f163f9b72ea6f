"""Helpers that several text operators use: shared intermediate tables, row ranks, Arrow access."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship as _ship

__all__ = ["chunks", "free_names", "materialize", "shared_dir", "ship", "sieve", "sieved", "text_buffers"]


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none (tests in one process) is a temporary folder used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    named = tempfile.mkdtemp(prefix="blockloom-")
    spark.conf.set("spark.checkpoint.dir", named)
    return named


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage with files that outlive executors, so a lost executor never
    recomputes what stands before this point.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the n+1 offsets of an Arrow string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at


def chunks(offsets: np.ndarray, most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of rows holding about ``most`` bytes; a longer row stands alone, whole."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + most, "right")) - 1
        end = min(max(end, start + 1), n)
        yield start, end
        start = end


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The names wanted, each lengthened until no column of ``df`` has it; Spark doesn't tell a from A."""
    used, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


SIEVE_BITS = 1 << 24  #: a sieve has SIEVE_BITS / 64 rows at most, however many keys go in


def sieve(keys: DataFrame, *columns: str) -> DataFrame:
    """(word, bits): a bit map of the hashed keys, small enough to be broadcast whatever its source."""
    place = F.pmod(F.xxhash64(*columns), F.lit(SIEVE_BITS))
    bit = F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64({', '.join(columns)}), {SIEVE_BITS}L), 64L) as int))")
    return materialize(keys.select(F.shiftright(place, 6).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")), "sieve")


def sieved(df: DataFrame, bits: DataFrame, name: str, *columns: str) -> DataFrame:
    """Adds boolean ``name``: false for most rows whose key isn't in the sieve, true for all whose key is.

    It keeps rows out of a shuffle; what passes by chance is met by the join behind it.
    """
    word, own = free_names(df, "word", "bits")
    place = f"pmod(xxhash64({', '.join(f'`{c}`' for c in columns)}), {SIEVE_BITS}L)"
    marked = df.withColumn(word, F.expr(f"cast(shiftright({place}, 6) as int)")).join(F.broadcast(bits.withColumnsRenamed({"word": word, "bits": own})), word, "left")
    return marked.withColumn(name, F.expr(f"coalesce(shiftright(`{own}`, cast(pmod({place}, 64L) as int)) & 1L, 0L) = 1L")).drop(word, own)


BATCH_ROWS = 1_000  #: rows of an Arrow batch, where the session leaves Spark's 10,000: texts are long


def ship(spark: SparkSession) -> None:
    """Prepares the session for the text operators' Python workers."""
    _ship(spark)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
