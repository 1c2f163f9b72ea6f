"""Sparse views of a matrix: coordinates, compressed rows, their log-domain twins, and conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def to_coo(rows: DataFrame, row: str = "row", values: str = "values") -> DataFrame:
    """(row, col, value) of the non-zero elements."""
    flat = rows.select(F.col(row).alias("row"), F.posexplode(values).alias("col", "value"))
    return flat.where("value <> 0").withColumn("col", F.col("col").cast("long"))


def to_log_coo(rows: DataFrame, row: str = "row", values: str = "values") -> DataFrame:
    coo = to_coo(rows, row, values)
    return coo.select("row", "col", F.log2(F.abs("value")).alias("log2_value"), (F.col("value") < 0).cast("int").alias("sign"))


def log_to_linear(coo: DataFrame) -> DataFrame:
    return coo.select("row", "col", (F.when(F.col("sign") == 0, 1.0).otherwise(-1.0) * F.pow(F.lit(2.0), "log2_value")).alias("value"))


def to_csr(rows: DataFrame, row: str = "row", values: str = "values", log: bool = False) -> DataFrame:
    """(row, nnz, row_ptr, cols, values): compressed rows, empty ones included.

    ``row_ptr`` is where the row begins among all non-zeros.  It is a running sum over
    the rows, made in two steps (within ranges of rows, then over the ranges), so no
    task sees all rows.
    """
    pick = F.filter(F.transform(values, lambda x, i: F.struct(i.alias("c"), x.alias("v"))), lambda e: e["v"] != 0)
    value = (lambda e: F.log2(F.abs(e["v"]))) if log else (lambda e: e["v"])
    packed = rows.select(F.col(row).alias("row"), pick.alias("e")).select("row", F.size("e").cast("long").alias("nnz"), F.transform("e", lambda e: e["c"]).alias("cols"), F.transform("e", value).alias("values"))
    return with_running_start(packed, "row", "nnz", "row_ptr")


def with_running_start(df: DataFrame, order: str, amount: str, name: str, span: int = 4096, levels: int = 2) -> DataFrame:
    """Adds the sum of ``amount`` over all smaller ``order``: within spans, spans of spans, and over a last table of one row for ``span ** levels``."""
    if not levels:
        before = F.coalesce(F.sum(amount).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return df.withColumn(name, before.cast("long"))
    key, total, start = f"_span{levels}", f"_sum{levels}", f"_start{levels}"
    df = df.withColumn(key, F.floor(F.col(order) / span))
    spans = with_running_start(df.groupBy(key).agg(F.sum(amount).alias(total)), key, total, start, span, levels - 1).drop(total)
    inside = F.coalesce(F.sum(amount).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return df.join(spans, key).withColumn(name, (F.col(start) + inside).cast("long")).drop(key, start)


def coo_to_csr(coo: DataFrame, n_rows: int) -> DataFrame:
    """(row, row_ptr) for rows 0 to ``n_rows``; duplicates are kept and counted."""
    spark = coo.sparkSession
    counts = spark.range(n_rows + 1).withColumnRenamed("id", "row").join(coo.groupBy("row").agg(F.count(F.lit(1)).alias("nnz")), "row", "left").fillna(0, ["nnz"])
    return with_running_start(counts, "row", "nnz", "row_ptr").select("row", "row_ptr")


def csr_to_coo(csr: DataFrame) -> DataFrame:
    flat = csr.select("row", F.posexplode(F.arrays_zip("cols", "values")).alias("k", "e"))
    return flat.select("row", F.col("e.cols").cast("long").alias("col"), F.col("e.values").alias("value"))
