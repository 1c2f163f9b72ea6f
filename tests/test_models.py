"""Files, catalogs, pipelines and dynamic programs."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.functions import naming as N
from blockloom.operators import blocks as B
from blockloom.operators import blocks_arrow as BA
from blockloom.operators import catalog as K
from blockloom.operators import quant_groups as Q
from blockloom.operators import sparse as S
from blockloom.operators import stats as T
from blockloom.operators import tokens as V
from blockloom.operators import trellis as R
from blockloom.plans import pipeline
from blockloom.sources import containers, safetensors
from blockloom.streaming import incremental


@pytest.fixture()
def model(tmp_path):
    rng = np.random.default_rng(5)
    source = tmp_path / "source"
    source.mkdir()
    arrays = {"model.layers.0.mlp.up_proj.weight": rng.normal(0, 1, (8, 64)).astype(np.float32), "model.norm.weight": rng.normal(0, 1, 16).astype(np.float16)}
    safetensors.write(str(source / "a.safetensors"), arrays)
    safetensors.write(str(source / "b.safetensors"), {"experts": rng.normal(0, 1, (2, 3, 32)).astype(np.float32)})
    return str(source), arrays


def test_headers_and_rows(spark, model):
    source, arrays = model
    assert {r.name for r in safetensors.headers(spark, source).collect()} == {*arrays, "experts"}
    got = safetensors.tensors(spark, source, ["model.layers.0.mlp.up_proj.weight"]).orderBy("row").collect()
    assert np.allclose([r["values"] for r in got], arrays["model.layers.0.mlp.up_proj.weight"])
    spark.dataSource.register(safetensors.TensorFileSource)
    assert spark.read.format("tensorfile").option("headers", "true").load(source).count() == 3
    assert spark.read.format("tensorfile").option("names", "experts").load(source).count() == 6


def test_source_errors(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        safetensors.files(spark, str(tmp_path))
    with pytest.raises(ValueError):
        safetensors.to_floats(b"1234", "I32")
    assert safetensors.to_floats(np.array([0x3F80], np.uint16).tobytes(), "BF16").tolist() == [1.0]
    assert safetensors.matrix_shape([64]) == (1, 64, 1)
    assert safetensors.matrix_shape([2, 4, 32, 64]) == (8, 32, 64)


def test_import_analyze_export(spark, model, tmp_path):
    source, _ = model
    config = pipeline.import_template(spark, source)
    stored = str(tmp_path / "stored")
    catalog = pipeline.import_model(spark, source, config, stored)
    assert catalog.count() == 4  # one matrix, one vector, two planes
    found = {r.name: r for r in pipeline.analyze(spark, stored).collect()}
    assert found["model.norm.weight"].quant_type == "f16"
    assert found["model.layers.0.mlp.up_proj.weight"].container_name == "blk.0.ffn_up.weight"
    out = tmp_path / "out"
    out.mkdir()
    export = pipeline.export_template(spark, stored) | {"shard_size": 700}
    export["quantization"]["per_tensor"]["experts"] = "nonsense"
    shards = pipeline.export_model(spark, stored, export, str(out)).collect()
    assert sum(r.tensors for r in shards) == 2
    assert all(open(r.path, "rb").read(4) == b"GGUF" and os.path.getsize(r.path) == r.size for r in shards)
    plan, _ = pipeline.export_records(spark, stored, export)
    assert plan.where("error is not null").select("name").collect()[0][0] == "experts"


def test_large_tensors_are_read_in_slices(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(8)
    arrays = {"a": rng.normal(0, 1, (100, 32)).astype(np.float32), "b": rng.normal(0, 1, (2, 3, 8)).astype(np.float16), "c, d": np.ones(5, np.float32), "none": np.ones((0, 4), np.float32)}
    safetensors.write(str(tmp_path / "x.safetensors"), arrays)
    monkeypatch.setattr(safetensors, "SLICE_BYTES", 1000)
    slices = safetensors._Reader({"path": str(tmp_path)}).partitions()
    assert max(s.stop - s.first for s in slices) <= 41 and len(slices) > 15
    rows = [r for s in slices for b in safetensors._batches(s) for r in b.to_pylist()]
    for name, a in arrays.items():
        own = [r for r in rows if r["name"] == name]
        planes, n, cols = safetensors.matrix_shape(list(a.shape))
        assert [(r["plane"], r["row"]) for r in own] == [(k // n, k % n) for k in range(planes * n)]
        assert np.allclose([r["values"] for r in own], a.reshape(planes * n, cols)) if own else not a.size
    monkeypatch.setattr(safetensors, "BATCH_VALUES", 100)  # several batches of a slice
    for name, a in arrays.items():
        own = [b for s in slices if s.name == name for b in safetensors._batches(s, "B8x8")]
        planes, n, cols = safetensors.matrix_shape(list(a.shape))
        assert [(p, r) for b in own for p, r in zip(b["plane"].to_pylist(), b["row"].to_pylist(), strict=True)] == [(k // n, k % n) for k in range(planes * n)]
        flat = np.concatenate([BA.unpack_lists(b.columns[4:], 8, 8)[0] for b in own] or [[]])
        plain = BA.pack_lists(a.reshape(-1).astype(float), np.arange(planes * n + 1) * cols, 8, 8)
        assert np.array_equal(flat, BA.unpack_lists(plain, 8, 8)[0])
    got = safetensors.tensors(spark, str(tmp_path), ["c, d", "b"])
    assert sorted({r.name for r in got.collect()}) == ["b", "c, d"]
    bad = np.ones((2, 2), np.float32)
    bad[1, 1] = np.inf
    safetensors.write(str(tmp_path / "x.safetensors"), {"bad": bad})
    with pytest.raises(Exception, match="finite"):
        safetensors.tensors(spark, str(tmp_path)).collect()


def test_export_with_vocabulary(spark, model, tmp_path):
    source, _ = model
    with open(f"{source}/tokenizer.json", "w") as f:
        json.dump({"model": {"type": "BPE", "vocab": {"<s>": 0, "a": 1, "</s>": 2}}}, f)
    with open(f"{source}/tokenizer_config.json", "w") as f:
        json.dump({"bos_token": "<s>", "eos_token": {"content": "</s>"}}, f)
    with open(f"{source}/config.json", "w") as f:
        json.dump({"model_type": "Mistral", "vocab_size": 3, "num_hidden_layers": 2}, f)
    stored, out = str(tmp_path / "stored"), tmp_path / "out"
    pipeline.import_model(spark, source, pipeline.import_template(spark, source), stored)
    assert pipeline.read_tokens(spark, f"{stored}/tokens").count() == 3
    with pytest.raises(ValueError):
        pipeline.read_tokens(spark, f"{stored}/catalog")
    out.mkdir()
    config = pipeline.export_template(spark, stored)
    (made,) = pipeline.export_model(spark, stored, config, str(out)).collect()
    metadata, tensors = containers.read_container_head(made.path)
    assert metadata["general.architecture"] == "llama" and metadata["llama.block_count"] == 2
    assert metadata["tokenizer.ggml.tokens"] == ["<s>", "a", "</s>"] and metadata["tokenizer.ggml.bos_token_id"] == 0
    assert pipeline.validate(spark, stored, config, str(out)).where("not ok").count() == 0
    (place,) = [t[4] for t in tensors if t[0] == "blk.0.ffn_up.weight"]
    raw = open(made.path, "rb").read()
    back = [np.frombuffer(raw[place + 34 * k : place + 34 * k + 2], "<f2")[0].astype(float) * np.frombuffer(raw[place + 34 * k + 2 : place + 34 * k + 34], np.int8) for k in range(16)]
    catalog, blocks = pipeline.open_model(spark, stored)
    own = pipeline.stored_rows(blocks, "B8x8").join(catalog.where("name like '%up_proj%'"), "uuid").orderBy("row").collect()
    want = np.array([r["values"] for r in own]).reshape(16, 32)
    assert np.abs(np.array(back) - want).max() <= np.abs(want).max() / 127
    os.truncate(made.path, made.size - 16)
    assert pipeline.validate(spark, stored, config, str(out)).where("not ok").count() == 1


def test_block_files(spark, tmp_path):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(r, np.where(rng.random(20) < 0.5, 0, rng.normal(0, 1, 20)).tolist()) for r in range(3)], "row long, values array<double>")
    for fmt in ("B8x4", "B16x8", "DualRow8x8"):
        blocks = B.encode(rows, fmt)
        data = containers.pack_matrix(blocks, fmt, 3, 20, {"note": "x"})
        assert containers.read_block_header(data)[:4] == (fmt, 3, 20, {"note": "x"})
        (tmp_path / fmt).write_bytes(data)
        back = containers.read_matrices(spark, str(tmp_path / fmt))
        same = lambda df: {(r.row, r.col): round(r.value, 5) for r in B.decode_elements(df, fmt).where("col < 20 and row < 3").collect()}
        assert same(back) == same(blocks)
    with pytest.raises(ValueError):
        containers.read_block_header(b"XXXX" + data[4:])


def test_sparse_golden(spark):
    coo = spark.createDataFrame([(0, 0, 1.0), (0, 2, 2.0), (1, 3, 3.0), (2, 0, 4.0), (2, 1, 5.0)], "row long, col long, value double")
    assert [r.row_ptr for r in S.coo_to_csr(coo, 3).orderBy("row").collect()] == [0, 2, 3, 5]
    assert [r.row_ptr for r in S.coo_to_csr(coo.limit(0), 3).orderBy("row").collect()] == [0, 0, 0, 0]
    rows = spark.createDataFrame([(0, [1.0, 0.0, 2.0, 0.0]), (1, [0.0, 0.0, 0.0, 3.0]), (2, [4.0, 5.0, 0.0, 0.0])], "row long, values array<double>")
    assert S.csr_to_coo(S.to_csr(rows)).exceptAll(coo).count() == 0


def test_saliency_chain(spark):
    up = spark.createDataFrame([(0, 2.0), (1, 3.0), (2, 1.0), (3, 4.0)], "col long, scale double")
    w = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0), (3, 0.5)], "col long, scale double")
    assert [r.scale for r in Q.chained(up, w).orderBy("col").collect()] == [2.0, 6.0, 4.0, 2.0]


def test_group_quantizers_check_channels(spark):
    rows = spark.createDataFrame([(0, [0.1] * 128)], "row long, values array<double>")
    with pytest.raises(ValueError):
        Q.symmetric(rows, [1.0] * 64)
    packed = Q.pack_words(Q.symmetric(rows))
    assert packed.count() == 16 and packed.first().word == 0xFFFFFFFF


def test_global_scale_of_nothing(spark):
    rows = spark.createDataFrame([(0, [0.0] * 8)], "row long, values array<double>")
    assert Q.global_scale(rows, "I8") == 1.0


def test_recommendation_and_fallback(spark):
    pick = lambda name, r, c, i: spark.range(1).select(T.recommend(F.lit(name), F.lit(r).cast("long"), F.lit(c), F.lit(i))).first()[0]
    assert pick("x", 10, 1, 0.5) == "f16"
    assert pick("x", 500, 1024, 0.5) == "q8_0"
    assert pick("model.embed_tokens.weight", 1000, 2048, 0.3) == "q8_0"
    assert pick("model.embed_tokens.weight", 1000, 2048, 0.2) == "q6_k"
    fall = lambda c, t: spark.range(1).select(T.fallback(F.lit(c), F.lit(t))).first()[0]
    assert [fall(256, "Q4_K_M"), fall(128, "Q4_K_M"), fall(64, "Q5_K_S"), fall(100, "Q6_K"), fall(17, "Q8_0"), fall(1, "F32")] == ["Q4_K_M", "Q8_0", "Q8_0", "F16", "F16", "F32"]


def test_shards(spark):
    sizes = spark.createDataFrame([(0, 5), (1, 6), (2, 4), (3, 20), (4, 1)], "ordinal long, bytes long")
    assert [r.shard for r in K.assign_shards(sizes, 10).orderBy("ordinal").collect()] == [0, 1, 1, 2, 3]
    assert spark.range(1).select(N.shard_file(F.lit("m"), F.lit(999))).first()[0] == "m-01000.gguf"


def test_tokenizer_folder(spark, tmp_path):
    (tmp_path / "tokenizer.json").write_text(json.dumps({"model": {"type": "BPE", "vocab": {"<s>": 0, "a": 1, "</s>": 2}}}))
    (tmp_path / "tokenizer_config.json").write_text(json.dumps({"bos_token": "<s>", "eos_token": {"content": "</s>"}, "tokenizer_class": "a"}))
    tokens = V.read_tokenizer(spark, str(tmp_path)).orderBy("id").collect()
    assert [(t.token, t.special, t.special_type) for t in tokens] == [("<s>", True, "bos_token"), ("a", False, ""), ("</s>", True, "eos_token")]
    ids = {r.key: r.id for r in V.special_ids(spark.createDataFrame(tokens)).collect()}
    assert ids == {"tokenizer.ggml.bos_token_id": 0, "tokenizer.ggml.eos_token_id": 2}


def test_smooth_path_is_optimal():
    rng = np.random.default_rng(0)
    costs = rng.random((5, 4, 6))
    path = R.smooth_path(costs, 0.17)

    def price(c, p):
        return sum(c[k, s] for k, s in enumerate(p)) + 0.17 * sum(abs(a - b) for a, b in zip(p, p[1:]))

    import itertools

    for c, p in zip(costs, path, strict=True):
        best = min(price(c, q) for q in itertools.product(range(6), repeat=4))
        assert abs(price(c, p.tolist()) - best) < 1e-9


def test_dual_states_are_optimal():
    import itertools

    rng = np.random.default_rng(3)
    a, b = rng.random((6, 2)), rng.random((6, 2))
    first, second = R.dual_states(a, b)
    grid = np.arange(R.STATES) / (R.STATES - 1)

    def price(k, s, t):
        own = sum((a[k, i] - grid[s[i]]) ** 2 + (b[k, i] - grid[t[i]]) ** 2 + R.COUPLING * abs(grid[s[i]] - grid[t[i]]) for i in range(2))
        return own + R.SMOOTH * (abs(grid[s[1]] - grid[s[0]]) + abs(grid[t[1]] - grid[t[0]]))

    for k in range(6):
        ka, kb = R.top_states(a[k]), R.top_states(b[k])
        best = min(price(k, s, t) for s in itertools.product(*ka.tolist()) for t in itertools.product(*kb.tolist()))
        assert abs(price(k, first[k], second[k]) - best) < 1e-12


def test_exact_median(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 501, 1000):
        x = np.round(rng.normal(0, 3, n), 2)
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "l double")
        assert abs(T.exact_median(df, "l") - float(np.median(x))) < 1e-12
    assert T.exact_median(df.limit(0), "l") is None


def test_running_start_over_many_spans(spark):
    df = spark.range(1000).selectExpr("id as row", "id % 7 as nnz")
    got = S.with_running_start(df, "row", "nnz", "at", span=10).orderBy("row").collect()
    want = np.append(0, np.cumsum([r.nnz for r in got]))[:-1]
    assert [r["at"] for r in got] == want.tolist()


@pytest.mark.parametrize("fmt", ["B8x4", "B8x8", "B16x4", "B16x8"])
def test_arrow_codec_makes_the_same_blocks(spark, fmt):
    from blockloom.operators import blocks_arrow

    rng = np.random.default_rng(11)
    rows = [(k, f"t{k % 3}", np.where(rng.random(n) < 0.3, 0, rng.normal(0, 10.0 ** rng.integers(-4, 4), n)).tolist()) for k, n in enumerate([0, 1, 7, 8, 9, 16, 33, 64, 64, 64])]
    rows += [(10, "t0", [0.0] * 20), (11, "t1", [2.0**k for k in range(-8, 9)])]
    df = spark.createDataFrame(rows, "row long, name string, values array<double>")
    plain, fast = B.encode(df, fmt, carry=("name",)), blocks_arrow.encode(df, fmt, carry=("name",))
    assert plain.columns == fast.columns
    key = lambda d: sorted((r.row_group, r.block, str(tuple(r))) for r in d.collect())
    assert key(plain) == key(fast)
    back = {r.row: r["values"] for r in blocks_arrow.decode(fast, fmt, ("name",)).collect()}
    want = {r.row: r["values"] for r in B.decode_rows(plain.drop("name"), fmt).collect()}
    assert back.keys() == want.keys()
    assert all(np.allclose(back[k], want[k], rtol=1e-12, atol=0) for k in back)


@pytest.mark.parametrize("fmt", ["B8x4", "B8x8", "B16x4", "B16x8"])
def test_packed_rows_hold_the_same_blocks(spark, fmt, monkeypatch):
    from blockloom.operators import blocks_arrow

    rng = np.random.default_rng(13)
    rows = [(k, f"t{k % 3}", np.where(rng.random(n) < 0.3, 0, rng.normal(0, 10.0 ** rng.integers(-4, 4), n)).tolist()) for k, n in enumerate([0, 1, 7, 8, 9, 16, 33, 64, 64, 0])]
    df = spark.createDataFrame([*rows, (10, "t0", [0.0] * 20)], "row long, name string, values array<double>").coalesce(1)
    plain, packed = B.encode(df, fmt, carry=("name",)), blocks_arrow.pack(df, fmt, carry=("name",))
    key = lambda d: sorted((r.row_group, r.block, str(tuple(r))) for r in d.collect())
    back = blocks_arrow.relational(packed, fmt, ("name",))
    assert back.columns == plain.columns and key(back) == key(plain)
    values = {r.row: r["values"] for r in blocks_arrow.unpack(packed, fmt, ("name",)).collect()}
    want = {r.row: r["values"] for r in B.decode_rows(plain.drop("name"), fmt).collect()}
    assert set(values) - set(want) == {0, 9} and all(values[k] == [] for k in (0, 9))
    assert all(np.allclose(values[k], want[k], rtol=1e-12, atol=0) for k in want)
    for name in ("t0", "t1", "t2"):
        counts = packed.where(F.col("name") == name).agg(F.sum("nnz"), F.sum("shifted")).first()
        assert tuple(counts) == tuple(B.statistics(plain.where(F.col("name") == name), fmt).select("nnz", "shifted").first())

    columns = blocks_arrow.pack_lists(np.arange(1.0, 31.0), np.array([0, 10, 10, 25, 30]), 8, 4)
    monkeypatch.setattr(blocks_arrow, "RUN_VALUES", 12)
    cut = list(blocks_arrow.runs(columns[0]))
    assert cut == [(0, 2), (2, 3), (3, 4)]
    parts = [blocks_arrow.unpack_lists([c.slice(a, b - a) for c in columns], 8, 4)[0] for a, b in cut]
    assert np.array_equal(np.concatenate(parts), blocks_arrow.unpack_lists(columns, 8, 4)[0])


def test_arrow_records_have_the_same_bytes(spark):
    from blockloom.operators import gguf as G
    from blockloom.operators import gguf_arrow

    rng = np.random.default_rng(12)
    x = rng.normal(0, 1, (6, 512)) * 10.0 ** rng.integers(-3, 3, (6, 1))
    x[1, :256], x[2], x[3] = 0, np.abs(x[2]), np.where(rng.random(512) < 0.9, 0, x[3])
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "row long, values array<double>")
    kinds = [*G.SYMMETRIC, *G.AFFINE, *G.K_AFFINE, *G.K_SYMMETRIC, "IQ4_XS", "IQ4_NL"]
    both = None
    for t in kinds:
        own = df.select(F.lit(t).alias("name"), "row", F.lit(t).alias("type"), "values")
        both = own if both is None else both.unionByName(own)
    fast = {(r.name, r.row): bytes(r.data).hex() for r in gguf_arrow.records(both).collect()}
    for t in kinds:
        older = t in G.SYMMETRIC or t in G.AFFINE
        made = G.records(G.legacy(df, t) if older else G.superblocks(df, t), t)
        plain = {}
        for r in sorted(made.collect(), key=lambda r: tuple(r)[:2]):
            plain[r.row] = plain.get(r.row, "") + r.bytes.lower()
        assert {k: fast[t, k] for k in plain} == plain, t


def test_trellis_scales_in_records(spark, model, tmp_path):
    from blockloom.operators import gguf_arrow as GA

    rng = np.random.default_rng(14)
    v = rng.normal(0, 1, (300, 256)) * np.repeat(2.0 ** rng.uniform(-2, 0, (300, 8)), 32, axis=1)
    v[0], v[1, :32] = 0, 0

    def parts(raw, t):
        d, dmin = (raw[:, k : k + 2].copy().view("<f2").astype(float)[:, 0] for k in (0, 2))
        low, mid, last = (raw[:, 4 + k : 8 + k].astype(int) for k in (0, 4, 8))
        s = np.concatenate((low & 63, last & 15 | low >> 6 << 4), axis=1)
        m = np.concatenate((mid & 63, last >> 4 | mid >> 6 << 4), axis=1)
        body = raw[:, 16:]
        high = np.unpackbits(body[:, :32], axis=1, bitorder="little") * 16 if t == "Q5_K" else 0
        quads = body[:, 32 if t == "Q5_K" else 0 :]
        codes = np.stack((quads & 15, quads >> 4), axis=2).reshape(len(raw), 256) + high
        back = codes.reshape(-1, 8, 32) * (d[:, None] * s)[:, :, None] - (dmin[:, None] * m)[:, :, None]
        return d, dmin, s, m, back.reshape(len(raw), 256)

    for t, top in (("Q4_K", 15), ("Q5_K", 31)):
        plain, none, some, stiff = (parts(GA.blocks_of(v, t, p), t) for p in (None, 0.0, 0.3, 1e6))
        for other in (none, some, stiff):  # only scales and codes differ
            assert all((plain[k] == other[k]).all() for k in (0, 1, 3))
        d, dmin, s, m, _ = some
        shifted = v.reshape(-1, 8, 32) + (dmin[:, None] * m)[:, :, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            logs = np.where(shifted > 0, np.log2(shifted), np.nan)
        for b in (0, 1, 2, 150, 299):  # the path is the cheapest: no change of one group's scale is cheaper
            x = logs[b][:, None, :] - np.log2(d[b] or 1) - np.log2(np.arange(1, 64))[None, :, None]
            err = np.nansum(np.maximum(-x, 0) + np.maximum(x - np.log2(top), 0), axis=2)
            price = lambda p: sum(err[g, k - 1] for g, k in enumerate(p)) + 0.3 * np.abs(np.diff(p)).sum()  # noqa: B023, E731
            best = price(s[b])
            assert all(best <= price([*s[b][:g], k, *s[b][g + 1 :]]) + 1e-9 for g in range(8) for k in range(1, 64))
        assert (np.ptp(stiff[2], axis=1) == 0).all()
        assert np.abs(np.diff(some[2])).sum() < np.abs(np.diff(none[2])).sum()
        step = np.repeat(d[:, None] * s, 32, axis=1)
        reached = (shifted.reshape(-1, 256) >= 0) & (shifted.reshape(-1, 256) <= top * step)
        assert (np.abs(some[4] - v) <= step / 2 + 1e-9)[reached].all() and reached.mean() > 0.5
    assert (GA.blocks_of(v, "Q6_K", 0.3) == GA.blocks_of(v, "Q6_K")).all()
    assert pipeline.scale_penalty({}) == 0.3 and pipeline.scale_penalty({"scale_optimization": "Trellis", "trellis_lambda": 1}) == 1.0
    assert pipeline.scale_penalty({"scale_optimization": "standard", "trellis_lambda": 0.3}) is None

    safetensors.write(f"{tmp_path}/w.safetensors", {"model.layers.0.mlp.up_proj.weight": v[:4].astype(np.float32)})
    stored = f"{tmp_path}/kept"
    pipeline.import_model(spark, str(tmp_path), pipeline.import_template(spark, str(tmp_path)), stored)
    config = pipeline.export_template(spark, stored)
    config["quantization"]["per_tensor"] = {"model.layers.0.mlp.up_proj.weight": "q4_k_m"}
    made = {}
    for way in ("trellis", "standard"):
        config["quantization"]["scale_optimization"] = way
        made[way] = [bytes(r.data) for r in pipeline.export_records(spark, stored, config)[1].orderBy("row").collect()]
    blocks = pipeline.stored_rows(pipeline.open_model(spark, stored)[1], "B8x8").orderBy("row").collect()
    held = np.array([r["values"] for r in blocks])
    assert made["trellis"] == [x.tobytes() for x in GA.blocks_of(held, "Q4_K", 0.3)] != made["standard"]
    assert made["standard"] == [x.tobytes() for x in GA.blocks_of(held, "Q4_K")]


def test_column_index_in_tiles(spark):
    rng = np.random.default_rng(7)
    x = np.where(rng.random((37, 5)) < 0.3, 0, rng.normal(0, 1, (37, 5)))
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "row long, values array<double>")
    turned = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x.T)], "row long, values array<double>")
    for fmt in ("B8x8", "B16x4", "DualRow8x8"):
        own = B.column_index(rows, fmt).select("col", "block", "scale_log", "rows")
        want = B.encode(turned, fmt).select("row_group", "block", "scale_log", "rows")
        key = lambda df: sorted((tuple(r)[:2], str(tuple(r)[2:])) for r in df.collect())
        assert key(own) == key(want)


def test_top_states():
    assert R.top_states(np.array([0.0]))[0].tolist() == list(range(8))
    assert R.top_states(np.array([1.0]))[0].tolist() == list(range(15, 7, -1))


def test_incremental_import(spark, model, tmp_path):
    source, _ = model
    out, checkpoint = str(tmp_path / "o"), str(tmp_path / "c")
    incremental.import_new_files(spark, source, out, checkpoint)
    n = incremental.imported(spark, out).count()
    safetensors.write(f"{source}/c.safetensors", {"late": np.ones((2, 16), np.float32)})
    incremental.import_new_files(spark, source, out, checkpoint)
    assert incremental.imported(spark, out).count() == n + 4
