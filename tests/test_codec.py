"""Codec expressions against numpy and the documented cases."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.functions import codec as C
from blockloom.functions.dims import FORMATS
from blockloom.operators import blocks as B
from blockloom.operators import gguf as G


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_f16_equals_numpy(spark):
    rng = np.random.default_rng(1)
    xs = np.concatenate((rng.normal(0, 1, 200), rng.normal(0, 1e-6, 200), 2.0 ** rng.integers(-24, 15, 50), [0.0, 1.5, -2.75, 65504.0, 2.0**-24]))
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i int, x double")
    got = {r.i: (r.y, r.b) for r in df.select("i", C.f16(F.col("x")).alias("y"), C.f16_bits(C.f16(F.col("x"))).alias("b")).collect()}
    for i, x in enumerate(xs):
        want = np.float16(x)
        assert got[i][0] == float(want)
        if want != 0:
            assert got[i][1] == int(want.view(np.uint16))


@pytest.mark.parametrize("value", [0.125, 0.5, 1.0, 1.5, 1.9])
def test_e1m7_is_close(spark, value):
    assert abs(one(spark, C.e1m7(F.lit(value))) / 128 - value) < 0.01


def test_codes_clamp(spark):
    assert one(spark, C.e0m4(F.lit(-0.5))) == 0
    assert one(spark, C.e0m4(F.lit(1.5))) == 15
    assert one(spark, C.e1m7(F.lit(3.0))) == 255


def test_nibbles(spark):
    assert one(spark, C.pack_nibbles(F.array(*map(F.lit, (1, 2, -1, 7, 5))))) == [0x21, 0x7F, 5]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.floats(-8, 8, width=32).filter(lambda x: x == 0 or abs(x) > 0.5), min_size=1, max_size=40), st.sampled_from(sorted(FORMATS)))
def test_round_trip(spark, values, fmt):
    """Present elements keep their sign; magnitudes stay within a few percent while a block spans few octaves."""
    f = FORMATS[fmt]
    rows = spark.createDataFrame([(0, values), (1, values[::-1])], "row long, values array<double>")
    got = {(r.row, r.col): r.value for r in B.decode_elements(B.encode(rows, fmt), fmt).collect()}
    for k, x in enumerate(values):
        y = got[0, k]
        assert (x == 0) == (y == 0)
        if x:
            assert x * y > 0
            assert abs(y) <= abs(x) * 1.01
            if f.bits == 8:
                assert abs(y) >= abs(x) * 0.9


def test_known_matrices(spark):
    ramp = [float(i) for i in range(1, 33)]
    rows = spark.createDataFrame([(0, ramp[:16]), (1, ramp[16:])], "row long, values array<double>")
    assert B.statistics(B.encode(rows, "B16x8"), "B16x8").first().nnz == 32
    sparse = spark.createDataFrame([(0, [1.0, 0.0, 2.0, 0.0]), (1, [0.0, 3.0, 0.0, 4.0])], "row long, values array<double>")
    assert B.statistics(B.encode(sparse, "B16x8"), "B16x8").first().nnz == 4
    empty = spark.createDataFrame([(r, [0.0] * 16) for r in range(4)], "row long, values array<double>")
    stats = B.statistics(B.encode(empty, "B16x8"), "B16x8").first()
    assert (stats.nnz, stats.importance, stats.memory_bytes) == (0, 0.0, 8)


def test_odd_rows_pair_with_zeros(spark):
    rows = spark.createDataFrame([(r, [1.0 + r] * 8) for r in range(3)], "row long, values array<double>")
    blocks = B.encode(rows, "DualRow8x4")
    assert blocks.count() == 2
    assert B.check_block_count(blocks, "DualRow8x4", 3, 8) is blocks
    with pytest.raises(ValueError):
        B.check_block_count(blocks, "DualRow8x4", 5, 8)


def test_levels(spark):
    cases = {-127.0: 0, 113.0: 15, 1.0: 8, -115.5: 1, 0.0: 8}
    for x, index in cases.items():
        assert one(spark, G.level_index(F.lit(x))) == index


def test_scales_pack_and_unpack(spark):
    for s, m in (([1, 15, 31, 63, 7, 22, 44, 55], [0, 8, 16, 32, 3, 19, 38, 60]),):
        u = one(spark, G.unpack_six(G.pack_six(F.array(*map(F.lit, s)), F.array(*map(F.lit, m)))))
        assert (list(u.scales), list(u.mins)) == (s, m)


@pytest.mark.parametrize("t", ["Q4_0", "Q5_0", "Q8_0", "Q4_1", "Q5_1"])
def test_small_blocks_decode_close(spark, t):
    rng = np.random.default_rng(2)
    rows = spark.createDataFrame([(r, rng.normal(0, 1, 64).tolist()) for r in range(4)], "row long, values array<double>")
    worst = G.error(rows, G.dequantized(G.legacy(rows, t), t), 32).agg(F.max("worst")).first()[0]
    assert worst < {"Q8_0": 0.02, "Q5_0": 0.2, "Q5_1": 0.2}.get(t, 0.4)
    sizes = {r[0] for r in G.records(G.legacy(rows, t), t).select(F.length("bytes")).collect()}
    assert sizes == {2 * {"Q8_0": 34, "Q4_0": 18, "Q5_0": 22, "Q4_1": 20, "Q5_1": 24}[t]}


@pytest.mark.parametrize("t,size", [("Q2_K", 84), ("Q3_K", 110), ("Q4_K", 144), ("Q5_K", 176), ("Q6_K", 210), ("IQ4_XS", 136), ("IQ4_NL", 130)])
def test_superblocks_have_their_size_and_decode(spark, t, size):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(r, rng.normal(0, 1, 256).tolist()) for r in range(2)], "row long, values array<double>")
    made = G.superblocks(rows, t)
    assert {r[0] for r in G.records(made, t).select(F.length("bytes")).collect()} == {2 * size}
    mean = G.error(rows, G.dequantized(made, t), 256).agg(F.avg("mean")).first()[0]
    assert mean < {"Q2_K": 0.6, "Q3_K": 0.3}.get(t, 0.15)


def test_what_cannot_be_made(spark):
    with pytest.raises(ValueError):
        G.family("IQ2_XS")
