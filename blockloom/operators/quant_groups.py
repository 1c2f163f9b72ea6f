"""Group quantizers with packed codes: unpacked, byte-packed, and 4-bit groups with and without zero points.

Groups are runs of the array of a row, so scales are found and codes made in one
projection.  Channel weights (activation scales) are one array for the matrix.
Columns that are null are missing: they count in no scale and have no code, and
a group of them is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec as C
from ..functions.dims import FLOAT_TYPES, INT_TYPES
from .stats import exact_median

GROUP = 128


def global_scale(rows: DataFrame, dtype: str, clip: float = 0.0, values: str = "values", center: float | None = None) -> float:
    """2 ** (median + range / 2 * (1 - clip)) over the greatest code; 1 for float types and empty matrices."""
    if dtype not in INT_TYPES:
        return 1.0
    logs = rows.select(F.explode(values).alias("x")).where("x <> 0").select(F.log2(F.abs("x")).alias("l"))
    r = logs.agg((F.max("l") - F.min("l")).alias("r")).first()
    middle = exact_median(logs, "l") if center is None else center
    return 1.0 if r.r is None else 2.0 ** (middle + r.r / 2 * (1 - clip)) / INT_TYPES[dtype][2]


def float_round(x: Column, dtype: str) -> Column:
    """Nearest value with the type's exponent range and mantissa; zero stays."""
    exponent_bits, mantissa, bias = FLOAT_TYPES[dtype]
    top = (1 << exponent_bits) - bias - 1

    def scaled(e: Column) -> Column:
        m = C.round_away((F.abs(x) / F.pow(F.lit(2.0), e) - 1) * (1 << mantissa)) / (1 << mantissa)
        return F.when(x < 0, -1.0).otherwise(1.0) * (1 + m) * F.pow(F.lit(2.0), e)

    return F.when(x == 0, F.lit(0.0)).otherwise(C.let(C.clamp(F.floor(F.log2(F.abs(x)) + C.SNAP).cast("double"), float(-bias), float(top)), scaled))


def unpacked(rows: DataFrame, dtype: str, scale: float | Column, row: str = "row", values: str = "values") -> DataFrame:
    """(row, codes): one code for each element; float types give rounded values."""
    if dtype in INT_TYPES:
        _, low, high = INT_TYPES[dtype]
        one = lambda x: C.clamp(C.round_away(x / scale), float(low), float(high)).cast("int")
    elif dtype == "F16":
        one = C.f16
    else:
        one = lambda x: float_round(x, dtype)
    return rows.select(F.col(row).alias("row"), F.transform(values, one).alias("codes"))


def byte_packed(rows: DataFrame, scale: float, row: str = "row", values: str = "values", dtype: str = "I4") -> DataFrame:
    """4-bit codes, two to a byte, the even column low; 8-bit codes as unsigned bytes.  Other types aren't packed."""
    codes = unpacked(rows, dtype, scale, row, values)
    if dtype == "I4":
        return codes.select("row", C.pack_nibbles(F.col("codes")).alias("bytes"))
    if dtype == "I8":
        return codes.select("row", F.transform("codes", lambda c: F.pmod(c, F.lit(256))).alias("bytes"))
    return codes


#: Pack formats: elements of a group (0: none).
PACKS = {"none": 0, "packed": 0, "awq": GROUP, "gptq": GROUP, "trellis_single": 0, "trellis_dual": 0}


def pack_factor(pack: str, bits: int) -> int:
    """Values in a stored element: of 32 bits for grouped and trellis formats, of 8 for packed ones."""
    if pack in ("awq", "gptq", "trellis_single", "trellis_dual"):
        return 32 // bits
    return 2 if pack == "packed" and bits == 4 else 1


def quantize(rows: DataFrame, dtype: str = "I4", pack: str = "none", clip: float = 0.0, center: float | None = None, act: list[float] | None = None, row: str = "row", values: str = "values") -> DataFrame:
    """One entry for all pack formats.

    ``center`` (log2) stands for the matrix's median where there is one scale.  A matrix
    without weight gets zeros and the scale 1.  Channel weights count in grouped formats
    only.  Gives (row, codes or bytes, scale) or the grouped columns.
    """
    if pack not in PACKS:
        raise ValueError(f"unknown pack format {pack}")
    if pack == "awq":
        return symmetric(rows, act, clip, row, values)
    if pack == "gptq":
        return affine(rows, act, clip, row, values)
    if pack.startswith("trellis"):
        from . import trellis

        own = rows.select(F.col(row).alias("row"), F.col(values).alias("values"))
        return trellis.trellis_single(own) if pack == "trellis_single" else trellis.trellis_dual(own)
    scale = global_scale(rows, dtype, clip, values, center)
    made = byte_packed(rows, scale, row, values, dtype) if pack == "packed" else unpacked(rows, dtype, scale, row, values)
    return made.withColumn("scale", F.lit(scale))


def _log_mean_bound(weights: Column, clip: float) -> Column:
    """2 ** (mean + range / 2 * (1 - clip)) over the logs of the non-zero magnitudes."""
    logs = F.transform(F.filter(weights, lambda x: x != 0), lambda x: F.log2(F.abs(x)))
    return C.let(logs, lambda y: F.pow(F.lit(2.0), C.array_sum(y) / F.size(y) + (F.array_max(y) - F.array_min(y)) / 2 * (1 - clip)))


def _effective(group: Column, clip: float) -> Column:
    some = F.filter(group, lambda x: x != 0)
    return F.when(F.lit(clip > 0) & (F.size(some) > 1), _log_mean_bound(group, clip)).otherwise(C.max_abs(group)) if clip > 0 else C.max_abs(group)


def _mean(act: Column) -> Column:
    """Mean of the channel weights of columns that are there."""
    return C.let(F.filter(act, lambda a: a.isNotNull()), lambda a: C.array_sum(a) / F.size(a))


def scale_symmetric(group: Column, act: Column | None, clip: float) -> Column:
    """Group scale for codes -8 to 7; 1 for groups without weight."""
    if act is None:
        eff = _effective(group, clip) / 7
    else:
        mean = _mean(act)
        eff = _effective(F.zip_with(group, act, lambda w, a: F.abs(w) * a), clip) / F.nullif(mean, F.lit(0.0)) / 7
    return C.let(eff, lambda s: F.when((s > 0), s).otherwise(1.0))


def range_affine(group: Column, act: Column | None, clip: float) -> Column:
    """struct(low, high) of the group, zeros included; both within the clipping bound if ``clip`` > 0."""
    low, high = F.array_min(group), F.array_max(group)
    if clip <= 0:
        return F.struct(low.alias("low"), high.alias("high"))
    weights = group if act is None else F.zip_with(group, act, lambda w, a: F.abs(w) * a)
    bound = _effective(weights, clip)
    if act is not None:
        bound = bound / F.nullif(_mean(act), F.lit(0.0))
    return C.let(bound, lambda b: F.struct(F.greatest(low, -b).alias("low"), F.least(high, b).alias("high")))


def _groups(rows: DataFrame, row: str, values: str, act: list[float] | None) -> DataFrame:
    made = rows.select(F.col(row).alias("row"), F.posexplode(C.slices(F.col(values), GROUP)).alias("grp", "g")).where(F.exists("g", lambda w: w.isNotNull()))
    if act is None:
        return made.withColumn("a", F.lit(None).cast("array<double>"))
    whole = F.array(*[F.lit(float(x)) for x in act])
    return made.withColumn("a", F.zip_with("g", F.slice(whole, F.col("grp") * GROUP + 1, F.size("g")), lambda w, a: F.when(w.isNotNull(), a)))


def _check(rows: DataFrame, act: list[float] | None, values: str, short: bool = False) -> None:
    """An error unless rows have a column for each scale; with ``short`` they may end before the last one."""
    if act is not None:
        sizes = rows.select(F.size(values).alias("n")).distinct()
        widths = [r[0] for r in sizes.where(F.col("n") > len(act) if short else F.col("n") != len(act)).limit(2).collect()]
        if widths:
            raise ValueError(f"{len(act)} channel scales for {widths} columns")


def symmetric(rows: DataFrame, act: list[float] | None = None, clip: float = 0.0, row: str = "row", values: str = "values", short: bool = False) -> DataFrame:
    """(row, grp, scale, codes): codes 0 to 15 around 8.

    With ``short`` a row may end before the last channel; it takes the scales of its own columns.
    """
    _check(rows, act, values, short)
    g = _groups(rows, row, values, act).withColumn("scale", scale_symmetric(F.col("g"), None if act is None else F.col("a"), clip))
    code = F.transform("g", lambda w: F.when(w.isNotNull(), (C.clamp(C.round_away(w / F.col("scale")), -8.0, 7.0) + 8).cast("int")))
    return g.select("row", "grp", "scale", code.alias("codes"))


def affine(rows: DataFrame, act: list[float] | None = None, clip: float = 0.0, row: str = "row", values: str = "values", short: bool = False) -> DataFrame:
    """(row, grp, scale, zero, codes): codes 0 to 15 from a zero point; ``short`` as in ``symmetric``."""
    _check(rows, act, values, short)
    g = _groups(rows, row, values, act).withColumn("r", range_affine(F.col("g"), None if act is None else F.col("a"), clip))
    flat = F.col("r.high") == F.col("r.low")
    g = g.withColumn("scale", F.when(flat, 1.0).otherwise((F.col("r.high") - F.col("r.low")) / 15))
    g = g.withColumn("zero", F.when(flat, 0.0).otherwise(C.clamp(C.round_away(-F.col("r.low") / F.col("scale")), 0.0, 15.0)))
    code = F.transform("g", lambda w: F.when(w.isNotNull(), C.clamp(C.round_away(w / F.col("scale") + F.col("zero")), 0.0, 15.0).cast("int")))
    return g.select("row", "grp", "scale", F.col("zero").cast("int").alias("zero"), code.alias("codes"))


def pack_words(groups: DataFrame) -> DataFrame:
    """(pack_row, out_feature, word): eight codes to an unsigned 32-bit word, transposed; an incomplete last word is dropped, and one with a missing column."""
    words = F.transform(F.filter(C.slices(F.col("codes").cast("array<double>"), 8), lambda s: F.size(s) == 8), lambda s: F.aggregate(F.transform(s, lambda c, i: c * F.pow(F.lit(16.0), i)), F.lit(0.0), lambda a, b: a + b).cast("long"))
    flat = groups.select("row", "grp", F.posexplode(words).alias("k", "word")).where("word is not null")
    return flat.select((F.col("grp") * (GROUP // 8) + F.col("k")).cast("long").alias("pack_row"), F.col("row").alias("out_feature"), "word")


def chained(upstream: DataFrame, current: DataFrame) -> DataFrame:
    """(col, scale, log2_scale): products of two channel scales; a channel missing on one side counts as 1."""
    both = upstream.select("col", F.col("scale").alias("u")).join(current.select("col", F.col("scale").alias("w")), "col", "full")
    product = F.coalesce("u", F.lit(1.0)) * F.coalesce("w", F.lit(1.0))
    return both.select("col", product.alias("scale"), F.log2(product).alias("log2_scale"))


#: Fixed value: the least positive normal single float; stands for scales of zero in logs.
TINY = 2.0**-126


def column_importance(channels: DataFrame) -> DataFrame:
    """channels(col, scale) with ``log2_importance``, the log of the scale's magnitude."""
    return channels.withColumn("log2_importance", F.log2(F.greatest(F.abs("scale"), F.lit(TINY))))


def chained_importance(upstream: DataFrame, current: DataFrame) -> DataFrame:
    """(col, log2_importance): sums of two tables of logs over the same columns."""
    u, c = upstream.select("col", F.col("log2_importance").alias("u")), current.select("col", F.col("log2_importance").alias("c"))
    both = u.join(c, "col", "full").withColumn("sum", F.col("u") + F.col("c"))
    checked = F.when(F.col("sum").isNull(), F.raise_error(F.concat(F.lit("column "), F.col("col").cast("string"), F.lit(" has one scale only"))).cast("double")).otherwise(F.col("sum"))
    return both.select("col", checked.alias("log2_importance"))


def activation_stats(importance: DataFrame) -> DataFrame:
    """(col, mean_abs, row_importance, sample_count) for quantizers that want activations: linear, without samples."""
    return importance.select("col", F.lit(1.0).alias("mean_abs"), F.pow(F.lit(2.0), "log2_importance").alias("row_importance"), F.lit(0).alias("sample_count"))


def zero_stats(columns: DataFrame) -> DataFrame:
    """The statistics of columns(col) of which nothing has been seen."""
    return columns.select("col", F.lit(0.0).alias("mean_abs"), F.lit(0.0).alias("row_importance"), F.lit(0).alias("sample_count"))


def saliency(coo: DataFrame, channels: DataFrame) -> DataFrame:
    """Adds importance = |value| * scale of the element's column; a column without a scale counts as 1."""
    return coo.join(channels.select("col", "scale"), "col", "left").withColumn("importance", F.abs("value") * F.coalesce("scale", F.lit(1.0))).drop("scale")
