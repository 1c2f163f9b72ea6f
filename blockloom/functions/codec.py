"""Column expressions of the block codec: half floats, log-domain codes, bit and nibble packing.

All arithmetic is in doubles with explicit roundings.  A code at a boundary is
settled by adding ``SNAP`` before it is cut off, so that logarithms that differ
in their last bit give the same code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SNAP = 1e-9


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once; usable inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def f16(x: Column) -> Column:
    """Nearest half float, ties to even; steps below 2**-14 are 2**-24."""
    exponent = F.when(F.abs(x) >= 2.0**-14, F.floor(F.log2(F.abs(x)))).otherwise(F.lit(-14))
    return F.when(x == 0, F.lit(0.0)).otherwise(let(exponent.cast("double"), lambda e: F.bround(x * F.pow(F.lit(2.0), 10 - e)) * F.pow(F.lit(2.0), e - 10)))


def e1m7(offset: Column) -> Column:
    """8-bit code of an offset below two octaves, in steps of 1/128."""
    return F.floor(F.least(F.greatest(offset, F.lit(0.0)), F.lit(2 - 1 / 128)) * 128 + SNAP).cast("int")


def e0m4(offset: Column) -> Column:
    """4-bit code of an offset below one octave, in steps of 1/16."""
    return F.floor(F.least(F.greatest(offset, F.lit(0.0)), F.lit(15 / 16)) * 16 + SNAP).cast("int")


def decode_offset(code: Column, bits: int) -> Column:
    return code / F.lit(128.0 if bits == 8 else 16.0)


def shift_of(bits: int) -> float:
    """Octaves that the shift bit stands for."""
    return 2.0 if bits == 8 else 1.0


def bit_map(flags: Column) -> Column:
    """An int with bit i set where flag i is true."""
    return F.aggregate(F.transform(flags, lambda f, i: F.when(f, F.expr("1")).otherwise(0) * F.pow(F.lit(2.0), i).cast("int")), F.lit(0), lambda a, b: (a + b).cast("int"))


def hex_byte(code: Column) -> Column:
    return F.lpad(F.hex(F.pmod(code, F.lit(256)).cast("long")), 2, "0")


def hex_le(value: Column, n_bytes: int) -> Column:
    """Little-endian bytes of a non-negative number, as hex digits."""
    value = value.cast("long")
    return F.concat(*[hex_byte(F.shiftright(value, 8 * k)) for k in range(n_bytes)])


def f16_bits(x: Column) -> Column:
    """The 16 bits of a number that is already a half float."""
    mag = F.abs(x)
    exponent = F.when(mag >= 2.0**-14, F.floor(F.log2(mag))).otherwise(F.lit(-14)).cast("double")
    normal = (exponent + 15) * 1024 + (mag * F.pow(F.lit(2.0), -exponent) - 1) * 1024
    small = mag * 2.0**24
    bits = F.when(mag == 0, F.lit(0.0)).when(mag >= 2.0**-14, normal).otherwise(small)
    return (bits + F.when(x < 0, 32768.0).otherwise(0.0)).cast("int")


def pack_nibbles(codes: Column) -> Column:
    """Bytes of two 4-bit codes, the even one low."""
    pairs = F.sequence(F.lit(0), F.floor((F.size(codes) - 1) / 2).cast("int"))
    return F.when(F.size(codes) == 0, F.array().cast("array<int>")).otherwise(
        F.transform(pairs, lambda k: (F.pmod(F.get(codes, 2 * k), F.lit(16)) + 16 * F.coalesce(F.pmod(F.get(codes, 2 * k + 1), F.lit(16)), F.lit(0))).cast("int"))
    )


def slices(values: Column, size: int) -> Column:
    """The array cut into runs of ``size``; the last may be shorter."""
    count = F.ceil(F.size(values) / F.lit(float(size))).cast("int")
    return F.when(count == 0, F.array().cast("array<array<double>>")).otherwise(F.transform(F.sequence(F.lit(0), count - 1), lambda b: F.slice(values, b * size + 1, size)))


def array_sum(values: Column, zero: float | int = 0.0) -> Column:
    return F.aggregate(values, F.lit(zero), lambda a, b: a + b)


def max_abs(values: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(values, F.abs)), F.lit(0.0))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def round_away(x: Column) -> Column:
    """Halves away from zero."""
    return F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5)).cast("double")
