"""Incremental import: new tensor files in a folder become blocks, each file once.

A stream over the folder with a checkpoint remembers what has been imported; every
micro-batch appends, under its batch number, so a batch that runs again after a
failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocks_arrow
from ..shipping import ship
from ..sources.safetensors import TENSOR, parse_header, rows_of


def _tensors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in TENSOR.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            base, entries = parse_header(content)
            for name, e in entries.items():
                a, b = e["data_offsets"]
                yield pd.DataFrame(list(rows_of(path, name, e, memoryview(content)[base + a : base + b])), columns=columns)


def import_new_files(spark: SparkSession, source: str, out: str, checkpoint: str, format: str = "B8x8"):
    """Imports what has arrived since the last call and ends; returns the finished query."""
    ship(spark)
    kinds = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kinds).option("pathGlobFilter", "*.safetensors").load(source)

    def keep(batch: DataFrame, number: int) -> None:
        rows = batch.select("path", "content").mapInPandas(_tensors, TENSOR)
        made = blocks_arrow.encode(rows, format, carry=("name", "plane")).select("name", "plane", F.col("row_group").alias("row"), "block", "scale_log", "rows")
        made.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = files.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def imported(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*")
