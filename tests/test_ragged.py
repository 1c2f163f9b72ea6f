"""Queries against their SQL twins where the last row is incomplete and numbers lie half-way between two roundings; many small tensors."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.functions import naming as N
from blockloom.operators import quant_groups as Q
from blockloom.plans import pipeline
from blockloom.plans.queries import ORACLES, QUERIES
from blockloom.sources import safetensors

from .conftest import SMALL
from .test_queries import plain


def same(spark, folder, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(columns).collect()), key=repr)
    made = con.execute(ORACLES[name])
    order = [d[0] for d in made.description]
    want = sorted((tuple(plain(r[order.index(c)]) for c in columns) for r in made.fetchall()), key=repr)
    assert got == want


@pytest.fixture(scope="module", params=[1, 6, 7])
def ragged(request, tmp_path_factory):
    """Vectors that four do not divide: the last row of 256 has 64, 128 or 192 columns."""
    folder = tmp_path_factory.mktemp("ragged")
    duckdb.connect().execute(f"copy (select * from '{SMALL}/embeddings.parquet' where vec_id < {request.param}) to '{folder}/embeddings.parquet' (format parquet)")
    return folder


@pytest.mark.parametrize("name", ["quant_awq_act", "quant_awq_act_clip", "quant_gptq_act", "record_q4_k", "record_q5_k", "record_q3_k", "superblock_weights"])
def test_last_row_is_short(spark, ragged, name):
    same(spark, ragged, name, "embeddings")


@pytest.fixture(scope="module")
def gaps(tmp_path_factory):
    """Vectors missing at each place of a row, two together, null or empty."""
    folder = tmp_path_factory.mktemp("gaps")
    null = "case when vec_id in (31, 37) then [] when vec_id not in (21, 30, 39) then embedding end as embedding"
    duckdb.connect().execute(f"copy (select vec_id, {null}, label from '{SMALL}/embeddings.parquet' where vec_id < 43 and vec_id not in (0, 5, 10, 15, 24, 25, 34, 35)) to '{folder}/embeddings.parquet' (format parquet)")
    return folder


@pytest.mark.parametrize("name", ["quant_awq_act", "quant_awq_act_clip", "quant_gptq_act", "quant_awq", "quant_awq_clip", "quant_gptq", "quant_gptq_clip", "gptq_params", "record_q5_k", "record_q3_k", "gguf_q5_k", "superblock_weights"])
def test_vectors_are_missing(spark, gaps, name):
    same(spark, gaps, name, "embeddings")


@pytest.mark.parametrize("made", [Q.symmetric, Q.affine])
def test_more_columns_than_scales(spark, made):
    rows = spark.createDataFrame([(0, [1.0] * 64), (1, [1.0] * 65)], "row long, values array<double>")
    with pytest.raises(ValueError, match="64 channel scales"):
        made(rows, [1.0] * 64, short=True)
    with pytest.raises(ValueError, match="65 channel scales"):
        made(rows, [1.0] * 65)


def test_bytes_half_way(spark):
    """Sizes half-way between two hundredths, next to them, and where they carry, as C prints them."""
    chance = random.Random(1)
    sizes = [0, 1023, 1024, 1048575, 1048576, (1 << 30) - 1, 1 << 30, (1 << 53) + 1, (1 << 63) - 1]
    for bits in (10, 20, 30):
        halves = [(1 << bits) * k // 8 for k in range(8, 80)]  # eighths: halves of a hundredth among them
        sizes += [h + d for h in halves for d in (-1, 0, 1)] + [chance.randrange(1 << bits, 1 << bits + 10) for _ in range(300)]
        sizes += [(2 << bits) - 1, (2 << bits) - (1 << bits) // 200]
    made = {r.n: r.t for r in spark.createDataFrame([(n,) for n in sizes], "n long").select("n", N.bytes_text(F.col("n")).alias("t")).collect()}
    for n, text in made.items():
        unit, size = next(((u, s) for u, s in (("GB", 1 << 30), ("MB", 1 << 20), ("KB", 1 << 10)) if n >= s), ("B", 1))
        assert text == (f"{n} B" if unit == "B" else f"{n / size:.2f} {unit}"), n


def test_bytes_query_half_way(spark, tmp_path):
    """Products that end in eighths of a KB lie half-way between two hundredths."""
    con = duckdb.connect()
    con.execute(f"copy (select p as page_id, repeat('x', n) as html from (values (8), (16), (24), (40), (368)) t(n), unnest(range(0, 40)) u(p)) to '{tmp_path}/pages.parquet' (format parquet)")
    same(spark, tmp_path, "format_bytes", "pages")


def test_small_tensors_share_a_task(spark, tmp_path, monkeypatch):
    """Tasks, and files of blocks, grow with the bytes and not with the number of tensors; a large tensor has several tasks."""
    source, stored = tmp_path / "source", tmp_path / "stored"
    source.mkdir()
    rng = np.random.default_rng(3)
    arrays = {f"t{k:03d}": rng.normal(0, 1, (8, 32)).astype(np.float32) for k in range(120)} | {"large": rng.normal(0, 1, (3000, 32)).astype(np.float32), "none": np.ones((0, 4), np.float32)}
    for at in range(0, 40):
        safetensors.write(str(source / f"part-{at:03d}.safetensors"), {n: a for k, (n, a) in enumerate(arrays.items()) if k % 40 == at})
    monkeypatch.setattr(safetensors, "SLICE_BYTES", 100_000)
    groups = safetensors._Grouped({"path": str(source)}).partitions()
    total = sum(a.nbytes for a in arrays.values())
    assert total / 100_000 <= len(groups) <= 2 * total / 100_000 + 1
    assert all(sum((s.stop - s.first) * s.width for s in g.parts) <= 100_000 for g in groups)
    assert len(safetensors._Grouped({"path": str(source), "headers": "true"}).partitions()) == 2
    assert [len(g.parts) for g in safetensors._Grouped({"path": str(source), "names": "none"}).partitions()] == [1]
    assert safetensors.tensors(spark, str(source), ["none"]).count() == 0
    monkeypatch.undo()
    rows = safetensors.tensors(spark, str(source)).orderBy("name", "row").collect()
    want = [(n, k) for n in sorted(arrays) for k in range(len(arrays[n]))]
    assert [(r.name, r.row) for r in rows] == want
    assert np.array_equal(np.stack([r["values"] for r in rows]), np.concatenate([arrays[n] for n in sorted(arrays) if n != "none"]))
    catalog = pipeline.import_model(spark, str(source), pipeline.import_template(spark, str(source)), str(stored))
    assert catalog.count() == len(arrays)
    assert spark.read.parquet(f"{stored}/blocks").count() == len(want)
    assert len(list((stored / "blocks").glob("*.parquet"))) <= 2
