"""Dimension tables: block formats, source dtypes, quantized types.  Fixed values of the storage model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Format:
    id: int
    name: str
    size: int  # elements of a row in a block
    bits: int
    dual: bool

    @property
    def mask_bytes(self) -> int:
        return self.size // 8

    @property
    def magnitude_bytes(self) -> int:
        return self.size * self.bits // 8

    @property
    def empty_bytes(self) -> int:
        return self.mask_bytes * (2 if self.dual else 1)

    @property
    def full_bytes(self) -> int:
        return (3 * self.mask_bytes + self.magnitude_bytes) * (2 if self.dual else 1) + 2


FORMATS = {f.name: f for f in (Format(k + 4 * dual, ("DualRow" if dual else "B") + f"{s}x{b}", s, b, bool(dual)) for dual in (0, 1) for k, (s, b) in enumerate(((8, 4), (8, 8), (16, 4), (16, 8))))}
DEFAULT_FORMAT = "B16x8"

#: Bytes of a source element; other dtypes count as 4.
DTYPE_BYTES = {"BOOL": 1, "U8": 1, "I8": 1, "F16": 2, "BF16": 2, "I16": 2, "U16": 2, "F32": 4, "I32": 4, "U32": 4, "F64": 8, "I64": 8, "U64": 8}

#: Elements and bytes of a block, by quantized type.
GGUF_TYPES = {
    "F32": (1, 4), "F16": (1, 2),
    "Q4_0": (32, 18), "Q4_1": (32, 20), "Q5_0": (32, 22), "Q5_1": (32, 24), "Q8_0": (32, 34),
    "Q2_K": (256, 84), "Q3_K_S": (256, 110), "Q3_K_M": (256, 110), "Q3_K_L": (256, 110), "Q4_K_S": (256, 144), "Q4_K_M": (256, 144),
    "Q5_K_S": (256, 176), "Q5_K_M": (256, 176), "Q6_K": (256, 210), "IQ4_XS": (256, 136), "IQ4_NL": (256, 130),
}
K_TYPES = tuple(t for t in GGUF_TYPES if t.endswith("_K") or "_K_" in t)
I_TYPES = ("IQ4_XS", "IQ4_NL")
UNBUILT = ("IQ1_S", "IQ1_M", "IQ2_XXS", "IQ2_XS", "IQ2_S", "IQ3_XXS", "IQ3_S")
ALIASES = {"Q3_K": "Q3_K_M", "Q4_K": "Q4_K_M", "Q5_K": "Q5_K_M"}

#: The 16 levels of the non-linear 4-bit types.
LEVELS = (-127, -104, -83, -65, -49, -35, -22, -10, 1, 13, 25, 38, 53, 69, 89, 113)

#: Integer quantization: bits, least and greatest code.
INT_TYPES = {"I4": (4, -8, 7), "I6": (6, -32, 31), "I8": (8, -128, 127), "I16": (16, -32768, 32767)}
#: Float quantization: exponent bits, mantissa bits, bias.
FLOAT_TYPES = {"F4": (2, 1, 1), "F6": (3, 2, 3), "F8": (4, 3, 7)}


def format_table(spark: SparkSession) -> DataFrame:
    rows = [(f.id, f.name, f.size, f.bits, f.dual, f.mask_bytes, f.magnitude_bytes, f.empty_bytes, f.full_bytes) for f in FORMATS.values()]
    return spark.createDataFrame(rows, "format_id int, format string, block_size int, bits int, is_dual boolean, mask_bytes int, mag_bytes int, empty_bytes int, full_bytes int")


def type_table(spark: SparkSession) -> DataFrame:
    rows = [(t, b, n, 8.0 * n / b, t in K_TYPES, t in I_TYPES) for t, (b, n) in GGUF_TYPES.items()]
    return spark.createDataFrame(rows, "quant_type string, block_size int, block_bytes int, bits_per_weight double, is_k boolean, is_i boolean")
