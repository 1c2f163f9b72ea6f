"""Block matrices: rows of values to log-domain blocks and back.

A matrix is a relation ``(row, values array<double>)``.  Encoding works on the
array of a row with higher-order functions: no element is exploded and nothing
is shuffled, whatever the size of the matrix.  Dual-row formats pair rows first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codec as C
from ..functions.dims import FORMATS


def _logs(values: Column) -> Column:
    return F.transform(values, lambda x: F.when(x != 0, F.log2(F.abs(x))))


def _row_part(values: Column, logs: Column, base: Column, lift: Column, bits: int) -> Column:
    """One row's share of a block: masks and codes; offsets are ``log - base + lift``."""
    t = C.shift_of(bits)
    code = C.e1m7 if bits == 8 else C.e0m4
    offsets = F.transform(logs, lambda y: y - base + lift)

    def parts(off: Column) -> Column:
        shifted = F.transform(off, lambda o: F.coalesce(o >= t - C.SNAP, F.lit(False)))
        return F.struct(
            C.bit_map(F.transform(values, lambda x: x != 0)).alias("zero_map"),
            C.bit_map(F.transform(values, lambda x: x < 0)).alias("signs"),
            C.bit_map(shifted).alias("octave_shift"),
            F.transform(off, lambda o: F.when(o.isNull(), F.lit(0)).otherwise(code(o - F.when(o >= t - C.SNAP, t).otherwise(0.0)))).alias("codes"),
        )

    return C.let(offsets, parts)


def _encode_single(values: Column, bits: int) -> Column:
    def of(logs: Column) -> Column:
        base = F.array_min(logs)
        return F.struct(F.coalesce(C.f16(base), F.lit(0.0)).alias("scale_log"), F.array(_row_part(values, logs, base, F.lit(0.0), bits)).alias("rows"))

    return C.let(_logs(values), of)


def _encode_dual(a: Column, b: Column, bits: int) -> Column:
    def of(logs: Column) -> Column:
        x, y = F.get(logs, F.lit(0)), F.get(logs, F.lit(1))
        low, high = C.f16(F.array_min(x)), C.f16(F.array_min(y))
        shared = F.least(low, high)
        return F.struct(
            F.coalesce(shared, F.lit(0.0)).alias("scale_log"),
            F.array(_row_part(a, x, F.array_min(x), low - shared, bits), _row_part(b, y, F.array_min(y), high - shared, bits)).alias("rows"),
        )

    return C.let(F.array(_logs(a), _logs(b)), of)


def encode(rows: DataFrame, format: str, row: str = "row", values: str = "values", carry: tuple[str, ...] = ()) -> DataFrame:
    """(row_group, block, scale_log, rows): one row a block.  Single-row formats keep the columns in ``carry``.

    ``rows`` holds one struct (zero_map, signs, octave_shift, codes) for single-row
    formats and two for dual ones, whose odd last row is paired with zeros.
    """
    f = FORMATS[format]
    if not f.dual:
        made = rows.select(F.col(row).alias("row_group"), *carry, F.posexplode(F.transform(C.slices(F.col(values), f.size), lambda v: _encode_single(v, f.bits))).alias("block", "b"))
        return made.select("row_group", *carry, "block", "b.scale_log", "b.rows")
    if carry:
        raise ValueError("dual-row formats carry no columns")
    pairs = rows.groupBy(F.floor(F.col(row) / 2).cast("long").alias("row_group")).agg(F.max(F.when(F.col(row) % 2 == 0, F.col(values))).alias("a"), F.max(F.when(F.col(row) % 2 == 1, F.col(values))).alias("b"))
    pairs = pairs.withColumn("b", F.coalesce("b", F.transform("a", lambda x: F.lit(0.0)))).withColumn("a", F.coalesce("a", F.transform("b", lambda x: F.lit(0.0))))
    both = F.zip_with(C.slices(F.col("a"), f.size), C.slices(F.col("b"), f.size), lambda x, y: _encode_dual(x, y, f.bits))
    made = pairs.select("row_group", F.posexplode(both).alias("block", "b"))
    return made.select("row_group", "block", "b.scale_log", "b.rows")


def element(part: Column, scale_log: Column, i: Column, bits: int) -> Column:
    """Decoded value of element ``i`` of a row part; 0 where absent."""
    log = scale_log + C.decode_offset(F.get(part["codes"], i), bits) + F.when(_bit(part["octave_shift"], i), C.shift_of(bits)).otherwise(0.0)
    return F.when(_bit(part["zero_map"], i), F.when(_bit(part["signs"], i), -1.0).otherwise(1.0) * F.pow(F.lit(2.0), log)).otherwise(0.0)


def _bit(mask: Column, i: Column) -> Column:
    return F.floor(mask / F.pow(F.lit(2.0), i)).cast("long") % 2 == 1


def block_rows(blocks: DataFrame, format: str) -> DataFrame:
    """(row, block, scale_log, part): a row for each matrix row of each block."""
    f = FORMATS[format]
    flat = blocks.select("row_group", "block", "scale_log", F.posexplode("rows").alias("k", "part"))
    return flat.select((F.col("row_group") * (2 if f.dual else 1) + F.col("k")).alias("row"), "block", "scale_log", "part")


def decode_elements(blocks: DataFrame, format: str, log: bool = False) -> DataFrame:
    """(row, col, value) of all elements, zeros included; with ``log`` (row, col, log2_value, sign) of the present ones."""
    f = FORMATS[format]
    flat = block_rows(blocks, format)
    if not log:
        flat = flat.withColumn("v", F.transform("part.codes", lambda c, i: element(F.col("part"), F.col("scale_log"), i, f.bits)))
        flat = flat.select("row", "block", F.posexplode("v").alias("i", "value"))
        return flat.select("row", (F.col("block") * f.size + F.col("i")).alias("col"), "value")
    part = F.col("part")
    logs = F.transform("part.codes", lambda c, i: F.struct((F.col("scale_log") + C.decode_offset(c, f.bits) + F.when(_bit(part["octave_shift"], i), C.shift_of(f.bits)).otherwise(0.0)).alias("l"), _bit(part["signs"], i).cast("int").alias("s"), _bit(part["zero_map"], i).alias("there")))
    flat = flat.select("row", "block", F.posexplode(logs).alias("i", "e")).where("e.there")
    return flat.select("row", (F.col("block") * f.size + F.col("i")).alias("col"), F.col("e.l").alias("log2_value"), F.col("e.s").alias("sign"))


def decode_rows(blocks: DataFrame, format: str) -> DataFrame:
    """(row, values): dense rows again; one shuffle by row."""
    f = FORMATS[format]
    flat = block_rows(blocks, format).withColumn("v", F.transform("part.codes", lambda c, i: element(F.col("part"), F.col("scale_log"), i, f.bits)))
    ordered = F.sort_array(F.collect_list(F.struct("block", "v")))
    return flat.groupBy("row").agg(F.flatten(F.transform(ordered, lambda x: x["v"])).alias("values"))


def bytes_hex(blocks: DataFrame, format: str) -> DataFrame:
    """(row_group, block, bytes): the serialised block as hex digits; an empty block is its zero maps only."""
    f = FORMATS[format]
    m = f.mask_bytes
    zero = F.concat_ws("", F.transform("rows", lambda p: C.hex_le(p["zero_map"], m)))
    codes = (lambda p: F.transform(p["codes"], C.hex_byte)) if f.bits == 8 else (lambda p: F.transform(C.pack_nibbles(p["codes"]), C.hex_byte))
    pad = f.magnitude_bytes * 2
    body = F.concat_ws("", F.transform("rows", lambda p: F.concat(C.hex_le(p["signs"], m), C.hex_le(p["octave_shift"], m), F.rpad(F.concat_ws("", codes(p)), pad, "0"))))
    some = F.exists("rows", lambda p: p["zero_map"] != 0)
    return blocks.select("row_group", "block", F.when(some, F.concat(zero, C.hex_le(C.f16_bits(F.col("scale_log")), 2), body)).otherwise(zero).alias("bytes"))


def statistics(blocks: DataFrame, format: str, by: list[str] | None = None) -> DataFrame:
    """nnz, shifted elements, importance and stored bytes, from masks alone."""
    f = FORMATS[format]
    ones = C.array_sum(F.transform("rows", lambda p: F.bit_count(p["zero_map"])), 0)
    shifted = C.array_sum(F.transform("rows", lambda p: F.bit_count(p["zero_map"].bitwiseAND(p["octave_shift"]))), 0)
    kept = blocks.withColumn("_n", ones.cast("long")).withColumn("_s", shifted.cast("long"))
    grouped = kept.groupBy(*by) if by else kept.groupBy()
    return grouped.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("nnz"),
        F.coalesce(F.sum("_s"), F.lit(0)).alias("shifted"),
        F.coalesce(F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0)), F.lit(0.0)).alias("importance"),
        F.coalesce(F.sum(F.when(F.col("_n") == 0, f.empty_bytes).otherwise(f.full_bytes)), F.lit(0)).cast("long").alias("memory_bytes"),
    )


def check_block_count(blocks: DataFrame, format: str, rows: int, cols: int) -> DataFrame:
    """The blocks, or an error when their number isn't the one that the shape asks for."""
    f = FORMATS[format]
    want = -(-rows // (2 if f.dual else 1)) * -(-cols // f.size)
    have = blocks.count()
    if have != want:
        raise ValueError(f"{have} blocks, but {rows} x {cols} in {format} has {want}")
    return blocks


def column_index(rows: DataFrame, format: str, row: str = "row", values: str = "values") -> DataFrame:
    """The column-major copy: (col, block, scale_log, rows), blocks of the rows of each column.

    One shuffle by column and run of rows, so a column of any length is made in blocks;
    ``row`` counts from 0, and rows that are missing count as zeros.
    """
    f = FORMATS[format]
    flat = rows.select(F.floor(F.col(row) / f.size).cast("long").alias("tile"), (F.col(row) % f.size).cast("int").alias("i"), F.posexplode(values).alias("c", "v"))
    tiles = flat.groupBy("c", "tile").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("x"), F.max("i").alias("last"))
    dense = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.element_at("x", i), F.lit(0.0)))
    width = 1 << 32  # a key of tile and column that keeps neighbouring columns together
    made = encode(tiles.select((F.col("tile") * width + F.col("c")).alias("row"), dense.alias("values")), format)
    if f.dual:
        width >>= 1
    return made.select((F.col("row_group") % width).alias("col"), F.floor(F.col("row_group") / width).cast("int").alias("block"), "scale_log", "rows")
