"""Block quantizers of the container format: 32-element blocks, 256-element super-blocks, level tables.

Everything is made from the array of a row in one projection, without a shuffle.
Results are relational (scales and codes as arrays); ``records`` makes bytes.

Scales are chosen so that the codes use their range: a super-block's factor is
its greatest group range over the greatest scale times the greatest code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec as C
from ..functions.dims import GGUF_TYPES, LEVELS, UNBUILT

#: type: (greatest magnitude, offset of codes, least, greatest), symmetric 32-element blocks.
SYMMETRIC = {"Q8_0": (127, 0, -127, 127), "Q4_0": (7, 8, -8, 7), "Q5_0": (15, 16, -16, 15)}
#: type: greatest code, affine 32-element blocks.
AFFINE = {"Q4_1": 15, "Q5_1": 31}
#: type: (group size, greatest code, greatest scale), affine super-blocks.
K_AFFINE = {"Q4_K": (32, 15, 63), "Q5_K": (32, 31, 63), "Q2_K": (16, 3, 15)}
#: type: (group size, greatest magnitude, greatest scale, offset), symmetric super-blocks.
K_SYMMETRIC = {"Q6_K": (16, 31, 63, 32), "Q3_K": (16, 3, 31, 4)}


def family(quant_type: str) -> str:
    t = quant_type.upper()
    if t in UNBUILT or t not in GGUF_TYPES and t not in K_AFFINE and t not in K_SYMMETRIC:
        raise ValueError(f"{quant_type} can't be made")
    return t[:-2] if t[-2:] in ("_S", "_M", "_L") and not t.startswith("IQ") else t


def _divided(x: Column, by: Column) -> Column:
    return F.when(by == 0, 0.0).otherwise(x / by)


def _legacy(v: Column, t: str) -> Column:
    if t in SYMMETRIC:
        top, offset, low, high = SYMMETRIC[t]
        return C.let(C.f16(C.max_abs(v) / top), lambda d: F.struct(d.alias("d"), F.lit(0.0).alias("m"), F.transform(v, lambda x: (C.clamp(C.round_away(_divided(x, d)), float(low), float(high)) + offset).cast("int")).alias("codes")))
    top = AFFINE[t]
    low = F.least(F.array_min(v), F.lit(0.0))
    high = F.greatest(F.array_max(v), F.lit(0.0))
    ends = F.struct(C.f16((high - low) / top).alias("d"), C.f16(low).alias("m"))
    return C.let(ends, lambda e: F.struct(e["d"].alias("d"), e["m"].alias("m"), F.transform(v, lambda x: C.clamp(C.round_away(_divided(x - e["m"], e["d"])), 0.0, float(top)).cast("int")).alias("codes")))


def legacy(rows: DataFrame, quant_type: str, row: str = "row", values: str = "values") -> DataFrame:
    """(row, block, d, m, codes) for blocks of 32; ``m`` is 0 for symmetric types."""
    t = family(quant_type)
    made = rows.select(F.col(row).alias("row"), F.posexplode(F.transform(C.slices(F.col(values), 32), lambda v: _legacy(v, t))).alias("block", "b"))
    return made.select("row", "block", "b.d", "b.m", "b.codes")


def _positive(g: Column) -> Column:
    return F.greatest(F.array_max(g), F.lit(0.0))


def _negative(g: Column) -> Column:
    return F.greatest(-F.array_min(g), F.lit(0.0))


def level_index(x: Column) -> Column:
    """Index of the nearest level, ties to the higher one."""
    middles = [(a + b) / 2 for a, b in zip(LEVELS, LEVELS[1:])]
    index = F.lit(0)
    for m in middles:
        index = index + (x >= m).cast("int")
    return index


def _super(v: Column, t: str) -> Column:
    none = F.array().cast("array<int>")
    if t in K_AFFINE:
        size, top, most = K_AFFINE[t]
        groups = C.slices(v, size)
        factors = F.struct(
            C.f16(F.array_max(F.transform(groups, lambda g: _positive(g) + _negative(g))) / (most * top)).alias("d"),
            C.f16(F.array_max(F.transform(groups, _negative)) / most).alias("dmin"),
        )

        def of(f: Column) -> Column:
            scales = F.transform(groups, lambda g: C.clamp(C.round_away(_divided(_positive(g) + _negative(g), top * f["d"])), 1.0, float(most)).cast("int"))
            mins = F.transform(groups, lambda g: C.clamp(C.round_away(_divided(_negative(g), f["dmin"])), 0.0, float(most)).cast("int"))
            both = F.struct(scales.alias("s"), mins.alias("m"))
            return C.let(both, lambda b: F.struct(
                f["d"].alias("d"), f["dmin"].alias("dmin"), b["s"].alias("scales"), b["m"].alias("mins"),
                F.transform(v, lambda x, i: C.clamp(C.round_away(_divided(x + f["dmin"] * F.get(b["m"], F.floor(i / size).cast("int")), f["d"] * F.get(b["s"], F.floor(i / size).cast("int")))), 0.0, float(top)).cast("int")).alias("codes")))

        return C.let(factors, of)
    if t in K_SYMMETRIC:
        size, top, most, offset = K_SYMMETRIC[t]
        code = lambda y: (C.clamp(C.round_away(y), -float(offset), float(top)) + offset).cast("int")
        unit = float(most * top)
    elif t == "IQ4_XS":
        size, top, most = 32, 120, 63
        code, unit = level_index, float(most * top)
    elif t == "IQ4_NL":
        d = C.f16(C.max_abs(v) / 113)
        return C.let(d, lambda d: F.struct(d.alias("d"), F.lit(0.0).alias("dmin"), none.alias("scales"), none.alias("mins"), F.transform(v, lambda x: level_index(_divided(x, d)).cast("int")).alias("codes")))
    else:
        raise ValueError(f"{t} has no super-blocks")
    groups = C.slices(v, size)

    def with_factor(d: Column) -> Column:
        scales = F.transform(groups, lambda g: C.clamp(C.round_away(_divided(C.max_abs(g), top * d)), 1.0, float(most)).cast("int"))
        return C.let(scales, lambda s: F.struct(d.alias("d"), F.lit(0.0).alias("dmin"), s.alias("scales"), none.alias("mins"), F.transform(v, lambda x, i: code(_divided(x, d * F.get(s, F.floor(i / size).cast("int")))).cast("int")).alias("codes")))

    return C.let(C.f16(C.max_abs(v) / unit), with_factor)


def superblocks(rows: DataFrame, quant_type: str, row: str = "row", values: str = "values") -> DataFrame:
    """(row, sb, d, dmin, scales, mins, codes) for super-blocks of 256."""
    t = family(quant_type)
    made = rows.select(F.col(row).alias("row"), F.posexplode(F.transform(C.slices(F.col(values), 256), lambda v: _super(v, t))).alias("sb", "b"))
    return made.select("row", "sb", "b.d", "b.dmin", "b.scales", "b.mins", "b.codes")


def dequantized(blocks: DataFrame, quant_type: str) -> DataFrame:
    """(row, block or sb, values) from the relational form."""
    t = family(quant_type)
    if t in SYMMETRIC:
        return blocks.select("row", "block", F.transform("codes", lambda c: (c - SYMMETRIC[t][1]) * F.col("d")).alias("values"))
    if t in AFFINE:
        return blocks.select("row", "block", F.transform("codes", lambda c: c * F.col("d") + F.col("m")).alias("values"))
    size = 256 if t == "IQ4_NL" else 32 if t == "IQ4_XS" else (K_AFFINE.get(t) or K_SYMMETRIC[t])[0]
    levels = F.array(*[F.lit(x) for x in LEVELS])
    scale = lambda i: F.lit(1) if t == "IQ4_NL" else F.get("scales", F.floor(i / size).cast("int"))
    if t in K_AFFINE:
        back = lambda c, i: c * F.col("d") * scale(i) - F.col("dmin") * F.get("mins", F.floor(i / size).cast("int"))
    elif t in K_SYMMETRIC:
        back = lambda c, i: (c - K_SYMMETRIC[t][3]) * F.col("d") * scale(i)
    else:
        back = lambda c, i: F.get(levels, c) * F.col("d") * scale(i)
    return blocks.select("row", "sb", F.transform("codes", back).alias("values"))


def pack_six(scales: Column, mins: Column) -> Column:
    """Eight 6-bit scales and eight 6-bit minima in twelve bytes, as an int array.

    The low four of each keep their bits and take two high bits of the upper four above theirs.
    """
    at = F.get
    low = [F.get(scales, F.lit(i)).bitwiseAND(63) + F.shiftleft(F.shiftright(at(scales, F.lit(i + 4)), 4), 6) for i in range(4)]
    mid = [F.get(mins, F.lit(i)).bitwiseAND(63) + F.shiftleft(F.shiftright(at(mins, F.lit(i + 4)), 4), 6) for i in range(4)]
    high = [at(scales, F.lit(i + 4)).bitwiseAND(15) + F.shiftleft(at(mins, F.lit(i + 4)).bitwiseAND(15), 4) for i in range(4)]
    return F.array(*[x.cast("int") for x in (*low, *mid, *high)])


def unpack_six(packed: Column) -> Column:
    """struct(scales, mins) from the twelve bytes."""
    b = [F.get(packed, F.lit(i)) for i in range(12)]
    scales = [x.bitwiseAND(63) for x in b[:4]] + [b[8 + i].bitwiseAND(15) + F.shiftleft(F.shiftright(b[i], 6), 4) for i in range(4)]
    mins = [x.bitwiseAND(63) for x in b[4:8]] + [F.shiftright(b[8 + i], 4).bitwiseAND(15) + F.shiftleft(F.shiftright(b[4 + i], 6), 4) for i in range(4)]
    return F.struct(F.array(*[x.cast("int") for x in scales]).alias("scales"), F.array(*[x.cast("int") for x in mins]).alias("mins"))


def pack_xs(scales: Column) -> Column:
    """Eight 6-bit scales as a 16-bit number of their high bits and four bytes of their low ones."""
    high = sum((F.shiftleft(F.shiftright(F.get(scales, F.lit(i)), 4), 2 * i) for i in range(1, 8)), F.shiftright(F.get(scales, F.lit(0)), 4))
    low = [F.get(scales, F.lit(2 * i)).bitwiseAND(15) + F.shiftleft(F.get(scales, F.lit(2 * i + 1)).bitwiseAND(15), 4) for i in range(4)]
    return F.array(high.cast("int"), *[x.cast("int") for x in low])


def unpack_xs(packed: Column) -> Column:
    """The eight scales from the 16-bit number and the four bytes."""
    at = lambda i: F.get(packed, F.lit(i))
    return F.array(*[(F.shiftright(at(1 + i // 2), 4 * (i % 2)).bitwiseAND(15) + F.shiftleft(F.shiftright(at(0), 2 * i).bitwiseAND(3), 4)).cast("int") for i in range(8)])


def log2_thresholds(levels: int, log_scale: Column) -> Column:
    """Upper ends of the codes 0 to levels - 2 in the log domain: log2(code + 1/2) above the scale's log."""
    return F.array(*[F.log2(F.lit(q + 0.5)) + log_scale for q in range(levels - 1)])


def log2_quantize(log_magnitude: Column, thresholds: Column) -> Column:
    """Number of thresholds strictly below a log magnitude."""
    return F.size(F.filter(thresholds, lambda t: log_magnitude > t))


def exp2_cubic(x: Column) -> Column:
    """2 ** x by a cubic in the fraction, up to 0.56 % off; for comparison only, the engine uses ``pow``."""
    f = x - F.floor(x)
    return F.pow(F.lit(2.0), F.floor(x)) * (1 + f * (0.6931471805599453 + f * (0.240226 + f * 0.055504)))  # fixed values: the cubic's factors


def superblock_weights(mean_abs: Column) -> Column:
    """For each super-block of 256, weights that add up to 256; ones where it is short or has no weight."""
    ones = F.array_repeat(F.lit(1.0), 256)
    return F.transform(C.slices(mean_abs, 256), lambda v: C.let(C.array_sum(v), lambda t: F.when((F.size(v) == 256) & (t > 1e-10), F.transform(v, lambda x: x * 256 / t)).otherwise(ones)))


def log_group_stats(values: Column) -> Column:
    """struct(log2_sum, log2_max, count, neg_count, neg_log2_max) of the non-zero values; the maxima are null without values."""
    some = F.filter(values, lambda x: x != 0)
    logs = lambda keep: F.array_max(F.transform(F.filter(values, keep), lambda x: F.log2(F.abs(x))))
    return F.struct(
        C.array_sum(F.transform(some, lambda x: F.log2(F.abs(x)))).alias("log2_sum"), logs(lambda x: x > 0).alias("log2_max"), F.size(some).alias("count"),
        F.size(F.filter(values, lambda x: x < 0)).alias("neg_count"), logs(lambda x: x < 0).alias("neg_log2_max"),
    )


def log_factors(stats: Column, top: int = 63) -> Column:
    """struct(d, dmin): half floats of the greatest positive and negative magnitude over ``top``, or 1."""
    one = lambda l: C.f16(F.coalesce(F.pow(F.lit(2.0), l) / top, F.lit(1.0)))
    return F.struct(one(stats["log2_max"]).alias("d"), one(stats["neg_log2_max"]).alias("dmin"))


def high_bits(codes: Column, bit: int = 4) -> Column:
    """One byte for eight codes: bit ``bit`` of each, the first lowest."""
    eights = F.sequence(F.lit(0), F.floor((F.size(codes) - 1) / 8).cast("int"))
    one = lambda k, j: F.coalesce(F.shiftleft(F.shiftright(F.get(codes, k * 8 + j), bit).bitwiseAND(1), j), F.lit(0))
    return F.transform(eights, lambda k: sum((one(k, j) for j in range(1, 8)), one(k, 0)).cast("int"))


def records(blocks: DataFrame, quant_type: str) -> DataFrame:
    """(row, block or sb, bytes) as hex digits: half-float factors, packed scales, then codes, low nibbles first.

    A super-block so short that its scales fill none of their packed bytes has no record: null.
    """
    t = family(quant_type)
    join = lambda a: C.let(F.filter(F.transform(a, C.hex_byte), lambda h: h.isNotNull()), lambda h: F.when(F.size(h) > 0, F.array_join(h, "")))
    half = lambda c: C.hex_le(C.f16_bits(c), 2)
    nibbles = lambda: join(C.pack_nibbles(F.col("codes")))
    key = "block" if t in SYMMETRIC or t in AFFINE else "sb"
    body = {
        "Q8_0": lambda: F.concat(half(F.col("d")), join(F.col("codes"))),
        "Q4_0": lambda: F.concat(half(F.col("d")), nibbles()),
        "Q5_0": lambda: F.concat(half(F.col("d")), join(high_bits(F.col("codes"))), nibbles()),
        "Q4_1": lambda: F.concat(half(F.col("d")), half(F.col("m")), nibbles()),
        "Q5_1": lambda: F.concat(half(F.col("d")), half(F.col("m")), join(high_bits(F.col("codes"))), nibbles()),
        "Q4_K": lambda: F.concat(half(F.col("d")), half(F.col("dmin")), join(pack_six(F.col("scales"), F.col("mins"))), nibbles()),
        "Q5_K": lambda: F.concat(half(F.col("d")), half(F.col("dmin")), join(pack_six(F.col("scales"), F.col("mins"))), join(high_bits(F.col("codes"))), nibbles()),
        "Q2_K": lambda: F.concat(join(F.zip_with("scales", "mins", lambda s, m: s + 16 * m)), join(F.transform(C.slices(F.col("codes").cast("array<double>"), 4), lambda q: sum((F.get(q, F.lit(j)) * 4**j for j in range(1, 4)), F.get(q, F.lit(0))).cast("int"))), half(F.col("d")), half(F.col("dmin"))),
        "Q3_K": lambda: F.concat(join(high_bits(F.col("codes"), 2)), join(F.transform(C.slices(F.col("codes").cast("array<double>"), 4), lambda q: sum(((F.get(q, F.lit(j)) % 4) * 4**j for j in range(1, 4)), F.get(q, F.lit(0)) % 4).cast("int"))), join(pack_six(F.slice("scales", 1, 8), F.slice("scales", 9, 8))), half(F.col("d"))),
        "Q6_K": lambda: F.concat(nibbles(), join(F.transform(C.slices(F.col("codes").cast("array<double>"), 4), lambda q: sum((F.floor(F.get(q, F.lit(j)) / 16) * 4**j for j in range(1, 4)), F.floor(F.get(q, F.lit(0)) / 16)).cast("int"))), join(F.col("scales")), half(F.col("d"))),
        "IQ4_NL": lambda: F.concat(half(F.col("d")), nibbles()),
        "IQ4_XS": lambda: C.let(pack_xs(F.col("scales")), lambda p: F.concat(half(F.col("d")), C.hex_le(F.get(p, F.lit(0)), 2), F.concat_ws("", F.transform(F.slice(p, 2, 4), C.hex_byte)), nibbles())),
    }[t]
    return blocks.select("row", key, body().alias("bytes"))


def error(rows: DataFrame, back: DataFrame, size: int, row: str = "row", values: str = "values") -> DataFrame:
    """(row, worst, mean) absolute error of a decoded matrix; the check before an export."""
    key = "block" if "block" in back.columns else "sb"
    cut = rows.select(F.col(row).alias("row"), F.posexplode(C.slices(F.col(values), size)).alias(key, "v"))
    gaps = cut.join(back, ["row", key]).select("row", F.explode(F.zip_with("v", "values", lambda a, b: F.abs(a - b))).alias("e"))
    return gaps.groupBy("row").agg(F.max("e").alias("worst"), F.avg("e").alias("mean"))
