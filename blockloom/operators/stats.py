"""Statistics of matrices and catalogs, and what follows from them: importance and recommended precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dims import DTYPE_BYTES, I_TYPES, K_TYPES


def nnz_density(rows: DataFrame, by: list[str], values: str = "values") -> DataFrame:
    grouped = rows.withColumn("_n", F.size(F.filter(values, lambda x: x != 0)).cast("long")).withColumn("_all", F.size(values).cast("long")).groupBy(*by)
    return grouped.agg(F.sum("_n").alias("nnz"), F.coalesce(F.sum("_n") / F.nullif(F.sum("_all"), F.lit(0)), F.lit(0.0)).alias("density"))


def log2_stats(coo: DataFrame, by: list[str]) -> DataFrame:
    """Median, range and number of the log magnitudes; zeros where there are none."""
    logs = coo.withColumn("_l", F.log2(F.abs("value")))
    return logs.groupBy(*by).agg(
        F.coalesce(F.median("_l"), F.lit(0.0)).alias("median"), F.coalesce(F.max("_l") - F.min("_l"), F.lit(0.0)).alias("range"), F.count("_l").alias("nnz"))


def exact_median(values: DataFrame, column: str, steps: tuple[int, ...] = (256, 1 << 20)) -> float | None:
    """The median of a column of logs, without sorting: counts by bins, then by finer ones, then of the values left.

    Logs of doubles lie within 2,098 octaves, so a table of bins is bounded; the last
    bins are narrower than single floats are apart, so few values are left.
    """
    known = values.where(F.col(column).isNotNull()).select(F.col(column).alias("x"))
    total = known.count()
    if not total:
        return None
    found = []
    for rank in sorted({(total - 1) // 2, total // 2}):
        part, left = known, rank
        for step in (*steps, None):
            key = F.col("x") if step is None else F.floor(F.col("x") * step)
            for at, n in sorted(tuple(r) for r in part.groupBy(key.alias("k")).count().collect()):
                if left < n:
                    break
                left -= n
            part = part.where(key == at)
        found.append(at)
    return sum(found) / len(found)


def recommend(name: Column, rows: Column, cols: Column, importance: Column, high: float = 0.2, medium: float = 0.1) -> Column:
    """Recommended quantized type; the first rule that holds decides."""
    low = F.lower(name)
    has = lambda *words: F.greatest(*[F.contains(low, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(low, F.lit(words[0]))
    return (
        F.when(cols % 32 != 0, "f16")
        .when(rows * cols < 1_000_000, "q8_0")
        .when(has("embed_tokens", "lm_head", "model.norm"), F.when(importance > high, "q8_0").otherwise("q6_k"))
        .when(has("attn.o_proj", "attn.v_proj", "mlp.down_proj"), F.when(importance > medium, "q6_k").otherwise("q5_k_m"))
        .otherwise("q4_k_m")
    )


def fallback(cols: Column, wanted: Column) -> Column:
    """The type that the row length allows: 256 for K and I types, 32 for the older ones, else half floats."""
    wide = wanted.isin(*K_TYPES, *I_TYPES)
    return F.when(wanted.isNull(), wanted).when(wanted.isin("F32", "F16"), wanted).when(wide & (cols % 256 == 0), wanted).when(wide & (cols % 32 == 0), "Q8_0").when(~wide & (cols % 32 == 0), wanted).otherwise("F16")


def dtype_bytes(dtype: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in DTYPE_BYTES.items() for x in pair])
    return F.coalesce(F.element_at(table, dtype), F.lit(4))


def elements_of(shape: Column) -> Column:
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, n: a * n)


def tensor_stats(catalog: DataFrame) -> DataFrame:
    """One row: tensors, elements, bytes, rank histogram, least and greatest tensor.  catalog(name, dtype, shape array<long>)."""
    c = catalog.withColumn("n", elements_of(F.col("shape"))).withColumn("b", F.col("n") * dtype_bytes(F.col("dtype"))).withColumn("rank", F.size("shape"))
    return c.agg(
        F.count(F.lit(1)).alias("tensors"), F.sum("n").alias("elements"), F.sum("b").cast("long").alias("bytes"),
        F.count_if(F.col("rank") == 1).alias("rank_1"), F.count_if(F.col("rank") == 2).alias("rank_2"), F.count_if(F.col("rank") == 3).alias("rank_3"),
        F.count_if((F.col("rank") > 3) | (F.col("rank") == 0)).alias("rank_4_up"), F.min("n").alias("least"), F.max("n").alias("greatest"),
    )


def dtype_histogram(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("dtype").count().orderBy(F.desc("count"), "dtype")


def export_stats(analyses: DataFrame) -> DataFrame:
    """(quant_type, tensors, percent, min/avg/max importance), most frequent type first."""
    total = analyses.count()
    g = analyses.groupBy("quant_type").agg(F.count(F.lit(1)).alias("tensors"), F.min("importance").alias("min_importance"), F.avg("importance").alias("avg_importance"), F.max("importance").alias("max_importance"))
    return g.withColumn("percent", 100.0 * F.col("tensors") / F.lit(float(max(total, 1)))).orderBy(F.desc("tensors"), "quant_type")
