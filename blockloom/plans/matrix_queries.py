"""Matrix, sparse and quantizer queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec as C
from ..functions.dims import FORMATS, LEVELS, format_table, type_table
from ..operators import blocks as B
from ..operators import gguf as G
from ..operators import quant_groups as Q
from ..operators import sparse as S
from ..operators import stats as T
from .relations import emb, emb256, embz, li, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


# ---- SQL twins: building blocks ----------------------------------------------

EMB = "m as (select vec_id as r, generate_subscripts(embedding, 1) - 1 as c, cast(unnest(embedding) as double) as v from embeddings)"
EMBZ = "m0 as (select vec_id as r, generate_subscripts(embedding, 1) - 1 as c, cast(unnest(embedding) as double) as x from embeddings), m as (select r, c, case when abs(x) < 0.05e0 then 0e0 else x end as v from m0)"
E256 = "m as (select vec_id // 4 as r, (vec_id % 4) * 64 + generate_subscripts(embedding, 1) - 1 as c, cast(unnest(embedding) as double) as v from embeddings)"


def sql_f16(x: str) -> str:
    e = f"(case when abs({x}) >= pow(2e0, -14) then floor(log2(nullif(abs({x}), 0e0))) else -14e0 end)"
    return f"(case when {x} = 0 then 0e0 else round_even({x} * pow(2e0, 10 - {e}), 0) * pow(2e0, {e} - 10) end)"


def sql_round(x: str) -> str:
    return f"(case when {x} < 0 then -floor(-({x}) + 0.5e0) else floor({x} + 0.5e0) end)"


def sql_clamp(x: str, lo: float, hi: float) -> str:
    return f"least(greatest({x}, {lo}e0), {hi}e0)"


def sql_div(a: str, b: str) -> str:
    return f"(case when {b} = 0 then 0e0 else ({a}) / nullif({b}, 0e0) end)"


def joined(column: str):
    return F.array_join(F.transform(F.col(column), lambda x: x.cast("string")), ",")


def sql_blocks(fmt: str, source: str) -> str:
    """CTEs that end in ``blk``: one row for each matrix row of each block."""
    f = FORMATS[fmt]
    t, m, cap = (2, 128, "1.9921875e0") if f.bits == 8 else (1, 16, "0.9375e0")
    pad = ""
    if f.dual:
        pad = ", top as (select max(r) as last from m), m1 as (select * from m union all select last + 1, c, 0e0 from m, top where last % 2 = 0 and r = last)"
    src = "m1" if f.dual else "m"
    base = f"""{source}{pad},
l as (select r, c // {f.size} as b, c % {f.size} as i, v, case when v <> 0 then log2(abs(nullif(v, 0e0))) end as l from {src}),
s as (select *, min(l) over (partition by r, b) as s from l),
g as (select *, {"min(" + sql_f16("s") + ") over (partition by r // 2, b)" if f.dual else sql_f16("s")} as shared from s),
o as (select *, l - s + {"(" + sql_f16("s") + " - shared)" if f.dual else "0e0"} as off from g),
k as (select *, case when v <> 0 and off >= {t}e0 - 1e-9 then 1 else 0 end as sh from o),
q as (select *, case when v = 0 then 0 else cast(floor(least(greatest(off - sh * {t}e0, 0e0), {cap}) * {m} + 1e-9) as integer) end as code from k)"""
    return base


def sql_block_rows(fmt: str) -> str:
    return f"""with {sql_blocks(fmt, EMBZ)}
select r as row, cast(b as integer) as block, round(coalesce(max(shared), 0e0), 6) + 0e0 as scale_log,
    cast(sum(case when v <> 0 then 1 << i else 0 end) as integer) as zero_map, cast(sum(case when v < 0 then 1 << i else 0 end) as integer) as signs,
    cast(sum(sh << i) as integer) as octave_shift, string_agg(cast(code as varchar), ',' order by i) as codes
from q group by r, b"""


# ---- codecs --------------------------------------------------------------------


@query("codec_e1m7", f"with {EMB} select r as row, cast(c as integer) as col, cast(floor(least(greatest(abs(v) * 8, 0e0), 1.9921875e0) * 128 + 1e-9) as integer) as code, floor(least(greatest(abs(v) * 8, 0e0), 1.9921875e0) * 128 + 1e-9) / 128 as decoded from m")
def codec_e1m7(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = emb(spark, sf_dir).select("row", F.posexplode("values").alias("col", "v"))
    return flat.select("row", "col", C.e1m7(F.abs("v") * 8).alias("code")).withColumn("decoded", C.decode_offset(F.col("code"), 8))


@query("codec_e0m4", f"with {EMB} select r as row, cast(c as integer) as col, cast(floor(least(greatest(v * 4, 0e0), 0.9375e0) * 16 + 1e-9) as integer) as code, floor(least(greatest(v * 4, 0e0), 0.9375e0) * 16 + 1e-9) / 16 as decoded from m")
def codec_e0m4(spark, sf_dir):
    flat = emb(spark, sf_dir).select("row", F.posexplode("values").alias("col", "v"))
    return flat.select("row", "col", C.e0m4(F.col("v") * 4).alias("code")).withColumn("decoded", C.decode_offset(F.col("code"), 4))


@query("f16_round", f"select l_orderkey, l_linenumber, l_partkey, {sql_f16('l_extendedprice')} as price, {sql_f16('l_discount')} as discount, {sql_f16('(l_tax * 1e-4)')} as tiny from lineitem")
def f16_round(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem")
    return t.select("l_orderkey", "l_linenumber", "l_partkey", C.f16(F.col("l_extendedprice")).alias("price"), C.f16(F.col("l_discount")).alias("discount"), C.f16(F.col("l_tax") * 1e-4).alias("tiny"))


@query(
    "format_table",
    "select cast(k + 4 * d as integer) as format_id, case when d = 1 then 'DualRow' else 'B' end || s || 'x' || b as format, cast(s as integer) as block_size, cast(b as integer) as bits, d = 1 as is_dual, cast(s // 8 as integer) as mask_bytes, cast(s * b // 8 as integer) as mag_bytes, cast(s // 8 * (1 + d) as integer) as empty_bytes, cast((3 * (s // 8) + s * b // 8) * (1 + d) + 2 as integer) as full_bytes from (values (0, 8, 4), (1, 8, 8), (2, 16, 4), (3, 16, 8)) f(k, s, b), (values (0), (1)) g(d)",
)
def formats(spark, sf_dir):
    return format_table(spark)


@query("type_table", "select quant_type, cast(b as integer) as block_size, cast(n as integer) as block_bytes, 8e0 * n / b as bits_per_weight, quant_type like '%K%' as is_k, quant_type like 'IQ%' as is_i from (values ('F32', 1, 4), ('F16', 1, 2), ('Q4_0', 32, 18), ('Q4_1', 32, 20), ('Q5_0', 32, 22), ('Q5_1', 32, 24), ('Q8_0', 32, 34), ('Q2_K', 256, 84), ('Q3_K_S', 256, 110), ('Q3_K_M', 256, 110), ('Q3_K_L', 256, 110), ('Q4_K_S', 256, 144), ('Q4_K_M', 256, 144), ('Q5_K_S', 256, 176), ('Q5_K_M', 256, 176), ('Q6_K', 256, 210), ('IQ4_XS', 256, 136), ('IQ4_NL', 256, 130)) t(quant_type, b, n)")
def types(spark, sf_dir):
    return type_table(spark)


# ---- blocks ---------------------------------------------------------------------


def _encode_query(fmt: str):
    def run(spark, sf_dir):
        flat = B.block_rows(B.encode(embz(spark, sf_dir), fmt), fmt)
        return flat.select("row", "block", (F.round("scale_log", 6) + 0.0).alias("scale_log"), "part.zero_map", "part.signs", "part.octave_shift", joined("part.codes").alias("codes"))

    return run


for _name, _fmt in (("encode_b8x4", "B8x4"), ("encode_b8x8", "B8x8"), ("encode_b16x4", "B16x4"), ("encode_b16x8", "B16x8"), ("encode_dual8x4", "DualRow8x4"), ("encode_dual8x8", "DualRow8x8"), ("encode_dual16x4", "DualRow16x4"), ("encode_dual16x8", "DualRow16x8")):
    query(_name, sql_block_rows(_fmt))(_encode_query(_fmt))

_DECODED = "(case when v = 0 then 0e0 else (case when v < 0 then -1 else 1 end) * pow(2e0, shared + code / {m}e0 + sh * {t}e0) end)"


@query("decode_dense", f"with {sql_blocks('B8x8', EMBZ)} select r as row, b * 8 + i as col, round({_DECODED.format(m=128, t=2)}, 6) + 0e0 as value from q")
def decode_dense(spark, sf_dir):
    return B.decode_elements(B.encode(embz(spark, sf_dir), "B8x8"), "B8x8").select("row", F.col("col").cast("long").alias("col"), (F.round("value", 6) + 0.0).alias("value"))


@query("decode_dual", f"with {sql_blocks('DualRow16x8', EMBZ)} select r as row, b * 16 + i as col, round({_DECODED.format(m=128, t=2)}, 6) + 0e0 as value from q")
def decode_dual(spark, sf_dir):
    return B.decode_elements(B.encode(embz(spark, sf_dir), "DualRow16x8"), "DualRow16x8").select("row", F.col("col").cast("long").alias("col"), (F.round("value", 6) + 0.0).alias("value"))


@query("decode_rows", f"with {sql_blocks('B16x4', EMBZ)} select r as row, count(*) as n, round(sum({_DECODED.format(m=16, t=1)}), 4) + 0e0 as total from q group by r")
def decode_rows(spark, sf_dir):
    d = B.decode_rows(B.encode(embz(spark, sf_dir), "B16x4"), "B16x4")
    return d.select("row", F.size("values").cast("long").alias("n"), (F.round(C.array_sum(F.col("values")), 4) + 0.0).alias("total"))


@query("decode_f16", f"with {sql_blocks('B8x8', EMBZ)} select r as row, b * 8 + i as col, round({sql_f16('x')}, 6) + 0e0 as value from (select r, b, i, {_DECODED.format(m=128, t=2)} as x from q)")
def decode_f16(spark, sf_dir):
    d = B.decode_elements(B.encode(embz(spark, sf_dir), "B8x8"), "B8x8")
    return d.select("row", F.col("col").cast("long").alias("col"), (F.round(C.f16(F.col("value")), 6) + 0.0).alias("value"))


@query("log_projection", f"with {sql_blocks('B16x8', EMBZ)} select r as row, b * 16 + i as col, round(shared + code / 128e0 + sh * 2e0, 6) + 0e0 as log2_value, case when v < 0 then 1 else 0 end as sign from q where v <> 0")
def log_projection(spark, sf_dir):
    d = B.decode_elements(B.encode(embz(spark, sf_dir), "B16x8"), "B16x8", log=True)
    return d.select("row", F.col("col").cast("long").alias("col"), (F.round("log2_value", 6) + 0.0).alias("log2_value"), "sign")


@query("row_elements", f"with {EMBZ} select c as col, v as value from m where r = 7 and v <> 0")
def row_elements(spark, sf_dir):
    return S.to_coo(embz(spark, sf_dir).where("row = 7")).select("col", "value")


@query("column_elements", f"with {EMBZ} select r as row, v as value from m where c = 5 and v <> 0")
def column_elements(spark, sf_dir):
    return embz(spark, sf_dir).select("row", F.get("values", F.lit(5)).alias("value")).where("value <> 0")


@query("block_predicates", f"with {sql_blocks('B8x8', EMBZ)} select r as row, cast(b as integer) as block, max(case when i = 3 and v <> 0 then 1 else 0 end) = 1 as has_3, max(case when i = 3 and v < 0 then 1 else 0 end) = 1 as negative_3, count(case when v <> 0 then 1 end) = 0 as is_empty from q group by r, b")
def block_predicates(spark, sf_dir):
    flat = B.block_rows(B.encode(embz(spark, sf_dir), "B8x8"), "B8x8")
    return flat.select("row", "block", (F.getbit("part.zero_map", F.lit(3)) == 1).alias("has_3"), (F.getbit("part.signs", F.lit(3)) == 1).alias("negative_3"), (F.col("part.zero_map") == 0).alias("is_empty"))


def _sql_bits(x: str) -> str:
    e = f"(case when abs({x}) >= pow(2e0, -14) then floor(log2(nullif(abs({x}), 0e0))) else -14e0 end)"
    return f"cast((case when {x} = 0 then 0e0 when abs({x}) >= pow(2e0, -14) then ({e} + 15) * 1024 + (abs({x}) * pow(2e0, -{e}) - 1) * 1024 else abs({x}) * 16777216e0 end) + (case when {x} < 0 then 32768 else 0 end) as integer)"


def _sql_hex(x: str) -> str:
    return f"lpad(lower(hex(cast(({x}) & 255 as bigint))), 2, '0')"


@query(
    "block_bytes_hex",
    f"""with {sql_blocks('B8x8', EMBZ)},
p as (select r, b, coalesce(max(shared), 0e0) as s, cast(sum(case when v <> 0 then 1 << i else 0 end) as integer) as z, cast(sum(case when v < 0 then 1 << i else 0 end) as integer) as g, cast(sum(sh << i) as integer) as o, string_agg(printf('%02x', code), '' order by i) as codes from q group by r, b),
h as (select *, {_sql_bits('s')} as bits from p)
select r as row_group, cast(b as integer) as block, case when z = 0 then printf('%02x', z) else printf('%02x', z) || printf('%02x', bits % 256) || printf('%02x', bits // 256) || printf('%02x', g) || printf('%02x', o) || codes end as bytes from h""",
)
def block_bytes_hex(spark, sf_dir):
    return B.bytes_hex(B.encode(embz(spark, sf_dir), "B8x8"), "B8x8").withColumn("bytes", F.lower("bytes"))


@query("block_count_check", f"with {EMBZ} select count(distinct r) * (max(c) // 8 + 1) as n_blocks from m")
def block_count_check(spark, sf_dir):
    rows = embz(spark, sf_dir)
    blocks = B.check_block_count(B.encode(rows, "B8x8"), "B8x8", rows.count(), 64)
    return blocks.agg(F.count(F.lit(1)).alias("n_blocks"))


@query("column_index", f"with t as (select vec_id as c, generate_subscripts(embedding, 1) - 1 as r, cast(unnest(embedding) as double) as x from embeddings), {sql_blocks('B16x8', 'm as (select r, c, case when abs(x) < 0.05e0 then 0e0 else x end as v from t)')} select r as col, cast(b as integer) as block, cast(sum(case when v <> 0 then 1 << i else 0 end) as integer) as zero_map, string_agg(cast(code as varchar), ',' order by i) as codes from q group by r, b")
def column_index(spark, sf_dir):
    made = B.column_index(embz(spark, sf_dir), "B16x8")
    return made.select("col", "block", F.col("rows")[0]["zero_map"].alias("zero_map"), F.array_join(F.transform(F.col("rows")[0]["codes"], lambda x: x.cast("string")), ",").alias("codes"))


# ---- statistics --------------------------------------------------------------------


@query("nnz_density", "select l_returnflag, count(case when l_quantity <> 0 then 1 end) + count(case when l_extendedprice <> 0 then 1 end) + count(case when l_discount <> 0 then 1 end) + count(case when l_tax <> 0 then 1 end) as nnz, round((count(case when l_quantity <> 0 then 1 end) + count(case when l_extendedprice <> 0 then 1 end) + count(case when l_discount <> 0 then 1 end) + count(case when l_tax <> 0 then 1 end)) / (4e0 * count(*)), 6) as density from lineitem group by l_returnflag")
def nnz_density(spark, sf_dir):
    return T.nnz_density(li(spark, sf_dir), ["l_returnflag"]).withColumn("density", F.round("density", 6))


@query("memory_bytes", f"with {sql_blocks('B16x8', EMBZ)} select cast(sum(case when n = 0 then 2 else 24 end) as bigint) as memory_bytes, cast(sum(n) as bigint) as nnz from (select count(case when v <> 0 then 1 end) as n from q group by r, b)")
def memory_bytes(spark, sf_dir):
    return B.statistics(B.encode(embz(spark, sf_dir), "B16x8"), "B16x8").select("memory_bytes", "nnz")


_STATS = "round(coalesce(median(l), 0e0), 6) + 0e0 as median, round(coalesce(max(l) - min(l), 0e0), 6) + 0e0 as range, count(l) as nnz"
_LOGS = "lg as (select r, c, log2(abs(nullif(v, 0e0))) as l from m where v <> 0)"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + 0.0 for c in columns})


@query("log2_stats", f"with {EMBZ}, {_LOGS} select {_STATS} from lg")
def log2_stats(spark, sf_dir):
    return _rounded(T.log2_stats(S.to_coo(embz(spark, sf_dir)), []), "median", "range")


@query("row_log2_center", f"with {EMBZ}, {_LOGS} select r as row, {_STATS} from lg group by r")
def row_log2_center(spark, sf_dir):
    return _rounded(T.log2_stats(S.to_coo(embz(spark, sf_dir)), ["row"]), "median", "range")


@query("col_log2_center", f"with {EMBZ}, {_LOGS} select c as col, {_STATS} from lg group by c")
def col_log2_center(spark, sf_dir):
    return _rounded(T.log2_stats(S.to_coo(embz(spark, sf_dir)), ["col"]), "median", "range")


@query("group_log2_stats", f"with {EMBZ}, l as (select r, c // 32 as g, v, log2(abs(nullif(v, 0e0))) as l from m) select r as row, g as grp, round(coalesce(sum(l), 0e0), 6) + 0e0 as sum_log2, round(coalesce(max(case when v > 0 then l end), 0e0), 6) + 0e0 as max_positive, count(l) as n, count(case when v < 0 then 1 end) as n_negative, round(coalesce(max(case when v < 0 then l end), 0e0), 6) + 0e0 as max_negative, {sql_f16('coalesce(pow(2e0, max(case when v > 0 then l end)) / 63, 1e0)')} as d from l group by r, g")
def group_log2_stats(spark, sf_dir):
    coo = S.to_coo(embz(spark, sf_dir)).withColumn("l", F.log2(F.abs("value")))
    g = coo.groupBy("row", F.floor(F.col("col") / 32).alias("grp"))
    made = g.agg(F.sum("l").alias("sum_log2"), F.max(F.when(F.col("value") > 0, F.col("l"))).alias("max_positive"), F.count("l").alias("n"), F.count_if(F.col("value") < 0).alias("n_negative"), F.max(F.when(F.col("value") < 0, F.col("l"))).alias("max_negative"))
    made = made.withColumn("d", C.f16(F.coalesce(F.pow(F.lit(2.0), "max_positive") / 63, F.lit(1.0))))
    return _rounded(made.fillna(0.0, ["max_positive", "max_negative"]), "sum_log2", "max_positive", "max_negative")


_LADDER = "case when cols % 32 <> 0 then 'f16' when n_rows * cols < 1000000 then 'q8_0' when contains(lower(name), 'embed_tokens') or contains(lower(name), 'lm_head') or contains(lower(name), 'model.norm') then case when importance > 0.2e0 then 'q8_0' else 'q6_k' end when contains(lower(name), 'attn.o_proj') or contains(lower(name), 'attn.v_proj') or contains(lower(name), 'mlp.down_proj') then case when importance > 0.1e0 then 'q6_k' else 'q5_k_m' end else 'q4_k_m' end"


@query(
    "tensor_importance",
    f"""with {sql_blocks('B8x8', EMBZ)},
t as (select label, cast(sum(sh) as bigint) as shifted, count(case when v <> 0 then 1 end) as nnz, count(distinct r) * 1000 as n_rows from q join embeddings on vec_id = r group by label)
select label, nnz, shifted, round(importance, 6) as importance, {_LADDER} as quant_type from (select *, 64 as cols, coalesce(shifted / cast(nullif(nnz, 0) as double), 0e0) as importance, 'model.layers.' || label || '.mlp.down_proj.weight' as name from t)""",
)
def tensor_importance(spark, sf_dir):
    """The flagship: rows to blocks, masks to importance, importance to a recommended type."""
    rows = embz(spark, sf_dir)
    stats = B.statistics(B.encode(rows, "B8x8", carry=("label",)), "B8x8", ["label"])
    sizes = rows.groupBy("label").agg((F.count(F.lit(1)) * 1000).alias("n_rows"))
    both = stats.join(sizes, "label").withColumn("name", F.format_string("model.layers.%d.mlp.down_proj.weight", "label"))
    return both.select("label", "nnz", "shifted", F.round("importance", 6).alias("importance"), T.recommend(F.col("name"), F.col("n_rows"), F.lit(64), F.col("importance")).alias("quant_type"))


_CASES = "('model.embed_tokens.weight', 32000, 4096, 0.3e0), ('lm_head.weight', 32000, 4096, 0.1e0), ('model.layers.0.self_attn.o_proj.weight', 4096, 4096, 0.15e0), ('model.layers.0.self_attn.v_proj.weight', 4096, 4096, 0.05e0), ('model.layers.1.mlp.down_proj.weight', 4096, 11008, 0.2e0), ('model.layers.1.mlp.up_proj.weight', 11008, 4096, 0.9e0), ('model.norm.weight', 4096, 1, 0.5e0), ('small.weight', 500, 1024, 0.5e0), ('odd.weight', 4096, 100, 0.5e0), ('model.layers.2.mlp.experts.3.w1.weight', 2048, 17, 0.1e0)"


def _cases(spark) -> DataFrame:
    rows = [
        ("model.embed_tokens.weight", 32000, 4096, 0.3), ("lm_head.weight", 32000, 4096, 0.1), ("model.layers.0.self_attn.o_proj.weight", 4096, 4096, 0.15), ("model.layers.0.self_attn.v_proj.weight", 4096, 4096, 0.05),
        ("model.layers.1.mlp.down_proj.weight", 4096, 11008, 0.2), ("model.layers.1.mlp.up_proj.weight", 11008, 4096, 0.9), ("model.norm.weight", 4096, 1, 0.5), ("small.weight", 500, 1024, 0.5), ("odd.weight", 4096, 100, 0.5), ("model.layers.2.mlp.experts.3.w1.weight", 2048, 17, 0.1),
    ]
    return spark.createDataFrame(rows, "name string, n_rows int, cols int, importance double")


@query("recommend_quant", f"select name, n_rows, cols, importance, {_LADDER} as quant_type from (values {_CASES}) t(name, n_rows, cols, importance)")
def recommend_quant(spark, sf_dir):
    return _cases(spark).withColumn("quant_type", T.recommend(F.col("name"), F.col("n_rows").cast("long"), F.col("cols"), F.col("importance")))


@query("select_fallback", "select cols, wanted, case when wanted in ('F32', 'F16') then wanted when wanted like 'IQ%' or wanted like '%\\_K%' escape '\\' then case when cols % 256 = 0 then wanted when cols % 32 = 0 then 'Q8_0' else 'F16' end when cols % 32 = 0 then wanted else 'F16' end as quant_type from (values (1), (17), (32), (64), (100), (128), (256), (4096)) a(cols), (values ('F32'), ('F16'), ('Q4_0'), ('Q8_0'), ('Q4_K_M'), ('Q6_K'), ('IQ4_XS')) b(wanted)")
def select_fallback(spark, sf_dir):
    cols = spark.createDataFrame([(x,) for x in (1, 17, 32, 64, 100, 128, 256, 4096)], "cols int")
    wanted = F.explode(F.array(*[F.lit(t) for t in ("F32", "F16", "Q4_0", "Q8_0", "Q4_K_M", "Q6_K", "IQ4_XS")]))
    return cols.withColumn("wanted", wanted).withColumn("quant_type", T.fallback(F.col("cols"), F.col("wanted")))


# ---- sparse views -----------------------------------------------------------------


@query("to_coo", f"with {EMBZ} select r as row, c as col, v as value from m where v <> 0")
def to_coo(spark, sf_dir):
    return S.to_coo(embz(spark, sf_dir))


@query("to_csr", f"with {EMBZ}, n as (select r, count(case when v <> 0 then 1 end) as nnz, string_agg(case when v <> 0 then cast(c as varchar) end, ',' order by c) as cols, round(sum(v), 4) + 0e0 as total from m group by r) select r as row, nnz, cast(coalesce(sum(nnz) over (order by r rows between unbounded preceding and 1 preceding), 0) as bigint) as row_ptr, coalesce(cols, '') as cols, total from n")
def to_csr(spark, sf_dir):
    csr = S.to_csr(embz(spark, sf_dir))
    return csr.select("row", "nnz", "row_ptr", joined("cols").alias("cols"), (F.round(C.array_sum(F.col("values")), 4) + 0.0).alias("total"))


@query("to_log_sparse", f"with {EMBZ} select r as row, c as col, round(log2(abs(nullif(v, 0e0))), 6) + 0e0 as log2_value, case when v < 0 then 1 else 0 end as sign from m where v <> 0")
def to_log_sparse(spark, sf_dir):
    return _rounded(S.to_log_coo(embz(spark, sf_dir)), "log2_value")


@query("log_to_linear", f"with {EMBZ} select r as row, c as col, round((case when v < 0 then -1 else 1 end) * pow(2e0, log2(abs(nullif(v, 0e0)))), 6) as value from m where v <> 0")
def log_to_linear(spark, sf_dir):
    return S.log_to_linear(S.to_log_coo(embz(spark, sf_dir))).withColumn("value", F.round("value", 6))


@query("to_log_csr", f"with {EMBZ}, n as (select r, count(case when v <> 0 then 1 end) as nnz, round(coalesce(sum(case when v <> 0 then log2(abs(nullif(v, 0e0))) end), 0e0), 4) + 0e0 as total from m group by r) select r as row, nnz, cast(coalesce(sum(nnz) over (order by r rows between unbounded preceding and 1 preceding), 0) as bigint) as row_ptr, total from n")
def to_log_csr(spark, sf_dir):
    csr = S.to_csr(embz(spark, sf_dir), log=True)
    return csr.select("row", "nnz", "row_ptr", (F.round(C.array_sum(F.col("values")), 4) + 0.0).alias("total"))


@query("coo_to_csr", "with coo as (select user_id as row from events), top as (select max(row) + 1 as n from coo), spine as (select unnest(range(0, n + 1)) as row from top), n as (select s.row, count(c.row) as nnz from spine s left join coo c on c.row = s.row group by s.row) select row, cast(coalesce(sum(nnz) over (order by row rows between unbounded preceding and 1 preceding), 0) as bigint) as row_ptr from n")
def coo_to_csr(spark, sf_dir):
    coo = table(spark, sf_dir, "events").select(F.col("user_id").alias("row"))
    return S.coo_to_csr(coo, coo.agg(F.max("row") + 1).first()[0])


@query("csr_to_coo", f"with {EMBZ} select r as row, c as col, v as value from m where v <> 0")
def csr_to_coo(spark, sf_dir):
    return S.csr_to_coo(S.to_csr(embz(spark, sf_dir)))


@query("pivot_sparse", "select user_id, count(distinct event_type) as nnz, round(sum(value), 4) as total from events group by user_id")
def pivot_sparse(spark, sf_dir):
    """A sparse matrix of users and event types, its elements summed values."""
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.sum("value").alias("value"))
    return e.groupBy("user_id").agg(F.count(F.lit(1)).alias("nnz"), F.round(F.sum("value"), 4).alias("total"))


# ---- group quantizers ------------------------------------------------------------------


def _global(dtype: str, top: int) -> str:
    return f"g as (select pow(2e0, median(l) + (max(l) - min(l)) / 2 * (1 - 0e0)) / {top} as s from lg)"


def _unpacked_query(dtype: str):
    def run(spark, sf_dir):
        rows = embz(spark, sf_dir)
        return Q.unpacked(rows, dtype, Q.global_scale(rows, dtype)).select("row", joined("codes").alias("codes"))

    return run


for _t, (_bits, _low, _high) in {"I4": (4, -8, 7), "I6": (6, -32, 31), "I8": (8, -128, 127), "I16": (16, -32768, 32767)}.items():
    query(f"quant_none_{_t.lower()}", f"with {EMBZ}, {_LOGS}, {_global(_t, _high)} select r as row, string_agg(cast(cast({sql_clamp(sql_round('(v / s)'), _low, _high)} as integer) as varchar), ',' order by c) as codes from m, g group by r")(_unpacked_query(_t))


def _sql_float(bits: int, mantissa: int, bias: int) -> str:
    top = (1 << bits) - bias - 1
    e = f"least(greatest(floor(log2(nullif(abs(v), 0e0)) + 1e-9), -{bias}e0), {top}e0)"
    m = sql_round(f"((abs(v) / pow(2e0, {e}) - 1) * {1 << mantissa})")
    return f"(case when v = 0 then 0e0 else (case when v < 0 then -1 else 1 end) * (1 + {m} / {1 << mantissa}e0) * pow(2e0, {e}) end)"


def _float_query(dtype: str):
    def run(spark, sf_dir):
        made = Q.unpacked(embz(spark, sf_dir), dtype, 1.0)
        return made.select("row", F.posexplode("codes").alias("col", "value")).select("row", F.col("col").cast("long").alias("col"), (F.round("value", 6) + 0.0).alias("value"))

    return run


for _t, _spec in {"F4": (2, 1, 1), "F6": (3, 2, 3), "F8": (4, 3, 7)}.items():
    query(f"quant_{_t.lower()}", f"with {EMBZ} select r as row, c as col, round({_sql_float(*_spec)}, 6) + 0e0 as value from m")(_float_query(_t))
query("quant_f16", f"with {EMBZ} select r as row, c as col, round({sql_f16('v')}, 6) + 0e0 as value from m")(_float_query("F16"))


@query("quant_packed_i4", f"with {EMBZ}, {_LOGS}, {_global('I4', 7)}, k as (select r, c, cast({sql_clamp(sql_round('(v / s)'), -8, 7)} as integer) as code from m, g), p as (select r, c // 2 as p, sum(case when c % 2 = 0 then (code + 16) % 16 else ((code + 16) % 16) * 16 end) as byte from k group by r, c // 2) select r as row, string_agg(cast(cast(byte as integer) as varchar), ',' order by p) as bytes from p group by r")
def quant_packed_i4(spark, sf_dir):
    rows = embz(spark, sf_dir)
    return Q.byte_packed(rows, Q.global_scale(rows, "I4")).select("row", joined("bytes").alias("bytes"))


ACT = [1.0 + 9.0 * i / 256 for i in range(256)]
_ACT = "(1 + 9e0 * c / 256)"


def _group_sql(weight: str, clip: float, act: bool) -> str:
    eff = f"max(abs({weight}))" if not clip else f"pow(2e0, avg(log2(nullif(abs({weight}), 0e0))) + (max(log2(nullif(abs({weight}), 0e0))) - min(log2(nullif(abs({weight}), 0e0)))) / 2 * (1 - {clip}e0))"
    return eff + (f" / avg({_ACT})" if act else "")


def _words(codes: str) -> str:
    return f"w as (select r, c // 8 as p, cast(sum(cast(code as bigint) << (4 * (c % 8))) as bigint) as word from ({codes}) group by r, c // 8) select p as pack_row, r as out_feature, word from w"


def _symmetric(name: str, clip: float, act: bool):
    weight = f"(v * {_ACT})" if act else "v"
    sql = f"with {E256}, s as (select r as sr, c // 128 as sg, {_group_sql(weight, clip, act)} / 7 as s from m group by r, c // 128), k as (select r, c, cast({sql_clamp(sql_round('(v / s)'), -8, 7)} + 8 as integer) as code from m join s on r = sr and c // 128 = sg), {_words('select * from k')}"

    def run(spark, sf_dir):
        return Q.pack_words(Q.symmetric(emb256(spark, sf_dir, placed=True), ACT if act else None, clip, short=True))

    query(name, sql)(run)


def _affine(name: str, clip: float, act: bool):
    weight = f"(v * {_ACT})" if act else "v"
    ends = "min(v) as lo0, max(v) as hi0" + (f", {_group_sql(weight, clip, act)} as bound" if clip else "")
    fit = "greatest(lo0, -bound) as lo, least(hi0, bound) as hi" if clip else "lo0 as lo, hi0 as hi"
    zero = sql_clamp(sql_round("(-lo / ((hi - lo) / 15))"), 0, 15)
    sql = f"with {E256}, s0 as (select r as sr, c // 128 as sg, {ends} from m group by r, c // 128), s1 as (select sr, sg, {fit} from s0), s as (select *, (hi - lo) / 15 as scale, {zero} as zero from s1), k as (select r, c, cast({sql_clamp(sql_round('(v / scale + zero)'), 0, 15)} as integer) as code from m join s on r = sr and c // 128 = sg), {_words('select * from k')}"

    def run(spark, sf_dir):
        return Q.pack_words(Q.affine(emb256(spark, sf_dir, placed=True), ACT if act else None, clip, short=True))

    query(name, sql)(run)


_symmetric("quant_awq", 0.0, False)
_symmetric("quant_awq_clip", 0.1, False)
_symmetric("quant_awq_act", 0.0, True)
_symmetric("quant_awq_act_clip", 0.1, True)
_affine("quant_gptq", 0.0, False)
_affine("quant_gptq_clip", 0.1, False)
_affine("quant_gptq_act", 0.1, True)


@query("gptq_params", f"with {E256}, s as (select r, c // 128 as grp, min(v) as lo, max(v) as hi from m group by r, c // 128) select r as row, cast(grp as integer) as grp, round((hi - lo) / 15, 6) as scale, cast({sql_clamp(sql_round('(-lo / ((hi - lo) / 15))'), 0, 15)} as integer) as zero from s")
def gptq_params(spark, sf_dir):
    return Q.affine(emb256(spark, sf_dir, placed=True)).select("row", "grp", F.round("scale", 6).alias("scale"), "zero")


@query("static_saliency", f"with {EMBZ}, ch as (select c as cc, max(abs(v)) as u, 1e0 / (1 + c) as w from m group by c) select c as col, round(u * w, 6) as scale, round(log2(u * w), 6) as log2_scale, round(sum(abs(v) * u * w), 4) as importance from m join ch on c = cc where v <> 0 group by c, u, w")
def static_saliency(spark, sf_dir):
    coo = S.to_coo(embz(spark, sf_dir))
    up = coo.groupBy("col").agg(F.max(F.abs("value")).alias("scale"))
    channels = Q.chained(up, up.select("col", (1.0 / (1 + F.col("col"))).alias("scale")))
    sums = Q.saliency(coo, channels).groupBy("col").agg(F.round(F.sum("importance"), 4).alias("importance"))
    return channels.join(sums, "col").select("col", F.round("scale", 6).alias("scale"), F.round("log2_scale", 6).alias("log2_scale"), "importance")


# ---- container quantizers -----------------------------------------------------------------


def _legacy_sql(t: str, exact: bool = False) -> str:
    kept = (lambda x: x) if exact else (lambda x: f"round({x}, 8)")
    if t in G.SYMMETRIC:
        top, off, lo, hi = G.SYMMETRIC[t]
        s = f"select r as sr, c // 32 as sb, {sql_f16(f'(max(abs(v)) / {top})')} as d, 0e0 as mm from m group by r, c // 32"
        code = f"{sql_clamp(sql_round(sql_div('v', 'd')), lo, hi)} + {off}"
    else:
        top = G.AFFINE[t]
        s = f"select sr, sb, {sql_f16(f'((hi - lo) / {top})')} as d, {sql_f16('lo')} as mm from (select r as sr, c // 32 as sb, least(min(v), 0e0) as lo, greatest(max(v), 0e0) as hi from m group by r, c // 32)"
        code = sql_clamp(sql_round(sql_div("v - mm", "d")), 0, top)
    return f"with {EMBZ}, s as ({s}) select r as row, cast(sb as integer) as block, {kept('d')} as d, {kept('mm')} + 0e0 as m, string_agg(cast(cast({code} as integer) as varchar), ',' order by c) as codes from m join s on r = sr and c // 32 = sb group by r, sb, d, mm"


def _legacy_query(t: str):
    return lambda spark, sf_dir: G.legacy(embz(spark, sf_dir), t).select("row", "block", F.round("d", 8).alias("d"), (F.round("m", 8) + 0.0).alias("m"), joined("codes").alias("codes"))


for _t in ("Q8_0", "Q4_0", "Q5_0", "Q4_1", "Q5_1"):
    query(f"gguf_{_t.lower()}", _legacy_sql(_t))(_legacy_query(_t))


def _super_sql(t: str, exact: bool = False) -> str:
    kept = (lambda x: x) if exact else (lambda x: f"round({x}, 8)")
    if t in G.K_AFFINE:
        size, top, most = G.K_AFFINE[t]
        return f"""with {E256},
g as (select r as gr, c // {size} as gg, greatest(max(v), 0e0) as p, greatest(-min(v), 0e0) as n from m group by r, c // {size}),
f as (select gr as fr, {sql_f16(f'(max(p + n) / {most * top})')} as d, {sql_f16(f'(max(n) / {most})')} as dm from g group by gr),
s as (select g.*, f.*, {sql_clamp(sql_round(sql_div('p + n', f'({top} * d)')), 1, most)} as sc, {sql_clamp(sql_round(sql_div('n', 'dm')), 0, most)} as mn from g join f on gr = fr),
sc as (select gr as xr, string_agg(cast(cast(sc as integer) as varchar), ',' order by gg) as scales, string_agg(cast(cast(mn as integer) as varchar), ',' order by gg) as mins from s group by gr)
select r as row, 0 as sb, {kept('d')} as d, {kept('dm')} as dmin, scales, mins, string_agg(cast(cast({sql_clamp(sql_round(sql_div('v + dm * mn', '(d * sc)')), 0, top)} as integer) as varchar), ',' order by c) as codes
from m join s on r = gr and c // {size} = gg join sc on r = xr group by r, d, dm, scales, mins"""
    if t == "IQ4_NL":
        index = " + ".join(f"(case when v / d >= {(a + b) / 2}e0 then 1 else 0 end)" for a, b in zip(LEVELS, LEVELS[1:]))
        return f"with {E256}, f as (select r as fr, {sql_f16('(max(abs(v)) / 113)')} as d from m group by r) select r as row, 0 as sb, {kept('d')} as d, 0e0 as dmin, '' as scales, '' as mins, string_agg(cast({index} as varchar), ',' order by c) as codes from m join f on r = fr group by r, d"
    if t == "IQ4_XS":
        size, top, most = 32, 120, 63
        code = " + ".join(f"(case when v / (d * sc) >= {(a + b) / 2}e0 then 1 else 0 end)" for a, b in zip(LEVELS, LEVELS[1:]))
    else:
        size, top, most, off = G.K_SYMMETRIC[t]
        code = f"{sql_clamp(sql_round(sql_div('v', '(d * sc)')), -off, top)} + {off}"
    return f"""with {E256},
g as (select r as gr, c // {size} as gg, max(abs(v)) as p from m group by r, c // {size}),
f as (select gr as fr, {sql_f16(f'(max(p) / {most * top})')} as d from g group by gr),
s as (select g.*, f.*, {sql_clamp(sql_round(sql_div('p', f'({top} * d)')), 1, most)} as sc from g join f on gr = fr),
sc as (select gr as xr, string_agg(cast(cast(sc as integer) as varchar), ',' order by gg) as scales from s group by gr)
select r as row, 0 as sb, {kept('d')} as d, 0e0 as dmin, scales, '' as mins, string_agg(cast(cast({code} as integer) as varchar), ',' order by c) as codes
from m join s on r = gr and c // {size} = gg join sc on r = xr group by r, d, scales"""


def _super_query(t: str):
    return lambda spark, sf_dir: G.superblocks(emb256(spark, sf_dir), t).select("row", "sb", F.round("d", 8).alias("d"), F.round("dmin", 8).alias("dmin"), joined("scales").alias("scales"), joined("mins").alias("mins"), joined("codes").alias("codes"))


for _t in ("Q2_K", "Q3_K", "Q4_K", "Q5_K", "Q6_K", "IQ4_XS", "IQ4_NL"):
    query(f"gguf_{_t.lower()}", _super_sql(_t))(_super_query(_t))


@query("dequant_error", f"with {EMBZ}, s as (select r as sr, c // 32 as sb, {sql_f16('(max(abs(v)) / 127)')} as d from m group by r, c // 32), e as (select r, abs(v - {sql_clamp(sql_round(sql_div('v', 'd')), -127, 127)} * d) as e from m join s on r = sr and c // 32 = sb) select r as row, round(max(e), 6) as worst, round(avg(e), 6) as mean from e group by r")
def dequant_error(spark, sf_dir):
    rows = embz(spark, sf_dir)
    made = G.error(rows, G.dequantized(G.legacy(rows, "Q8_0"), "Q8_0"), 32)
    return made.select("row", F.round("worst", 6).alias("worst"), F.round("mean", 6).alias("mean"))


def _record_query(t: str):
    def run(spark, sf_dir):
        made = G.legacy(embz(spark, sf_dir), t) if t in G.SYMMETRIC or t in G.AFFINE else G.superblocks(emb256(spark, sf_dir), t)
        return G.records(made, t).withColumn("bytes", F.lower("bytes"))

    return run



def _sql_hexes(items: str) -> str:
    return f"array_to_string(list_transform({items}, lambda x: printf('%02x', cast(x as integer) & 255)), '')"


def _sql_half(x: str) -> str:
    return f"(select printf('%02x%02x', h % 256, h // 256) from (select {_sql_bits(x)} as h))"


def _sql_quads(items: str, value: str) -> str:
    """A byte for four codes, two bits each, the first lowest; ``value`` has {0} for a code."""
    return _sql_hexes(f"list_transform(range(0, len({items}) // 4), lambda k: " + " + ".join(f"{4**j} * ({value.format(f'{items}[4 * k + {j + 1}]')})" for j in range(4)) + ")")


def _sql_six(s: str, m: str) -> str:
    low = [f"({x}[{i}] & 63) + (({x}[{i + 4}] >> 4) << 6)" for x in (s, m) for i in range(1, 5)]
    return f"[{', '.join(low + [f'({s}[{i}] & 15) + (({m}[{i}] & 15) << 4)' for i in range(5, 9)])}]"


def _record_sql(t: str) -> str:
    """The bytes of a block from its factors, scales and codes, in SQL of its own."""
    older = t in G.SYMMETRIC or t in G.AFFINE
    key = "block" if older else "sb"
    c, s, m = "cl", "sl", "ml"
    nibbles = _sql_hexes(f"list_transform(range(0, len({c}) // 2), lambda k: {c}[2 * k + 1] % 16 + 16 * ({c}[2 * k + 2] % 16))")

    def high(bit: int) -> str:
        return _sql_hexes(f"list_transform(range(0, len({c}) // 8), lambda k: " + " + ".join(f"((({c}[8 * k + {j + 1}] >> {bit}) & 1) << {j})" for j in range(8)) + ")")

    xs = " + ".join(f"(({s}[{i + 1}] >> 4) << {2 * i})" for i in range(8))
    pairs = ", ".join(f"({s}[{2 * i + 1}] & 15) + (({s}[{2 * i + 2}] & 15) << 4)" for i in range(4))
    d, dm = _sql_half("d"), _sql_half("m" if older else "dmin")
    six = _sql_hexes(_sql_six(s, m))
    parts = {
        "Q8_0": [d, _sql_hexes(c)], "Q4_0": [d, nibbles], "Q5_0": [d, high(4), nibbles], "Q4_1": [d, dm, nibbles], "Q5_1": [d, dm, high(4), nibbles],
        "Q4_K": [d, dm, six, nibbles], "Q5_K": [d, dm, six, high(4), nibbles],
        "Q2_K": [_sql_hexes(f"list_transform(range(1, 17), lambda k: {s}[k] + 16 * {m}[k])"), _sql_quads(c, "{0}"), d, dm],
        "Q3_K": [high(2), _sql_quads(c, "{0} % 4"), _sql_hexes(_sql_six(f"{s}[1:8]", f"{s}[9:16]")), d],
        "Q6_K": [nibbles, _sql_quads(c, "{0} // 16"), _sql_hexes(s), d],
        "IQ4_NL": [d, nibbles], "IQ4_XS": [d, f"(select printf('%02x%02x', h % 256, h // 256) from (select cast({xs} as integer) as h))", _sql_hexes(f"[{pairs}]"), nibbles],
    }[t]
    codes = _legacy_sql(t, True) if older else _super_sql(t, True)
    numbers = lambda x: f"list_transform(list_filter(string_split({x}, ','), lambda x: x <> ''), lambda x: cast(x as integer))"
    lists = f"{numbers('codes')} as cl" + ("" if older else f", {numbers('scales')} as sl, {numbers('mins')} as ml")
    return f"select row, {key}, {' || '.join(parts)} as bytes from (select *, {lists} from ({codes}))"


for _t in (*G.SYMMETRIC, *G.AFFINE, *G.K_AFFINE, *G.K_SYMMETRIC, "IQ4_XS", "IQ4_NL"):
    query(f"record_{_t.lower()}", _record_sql(_t))(_record_query(_t))

_SCALES = "t(id, s, m) as (values (0, [1, 15, 31, 63, 7, 22, 44, 55], [7, 22, 44, 55, 1, 15, 31, 63]), (1, [0, 8, 16, 32, 3, 19, 38, 60], [3, 19, 38, 60, 0, 8, 16, 32]))"


def _scales(spark) -> DataFrame:
    return spark.createDataFrame([(0, [1, 15, 31, 63, 7, 22, 44, 55], [7, 22, 44, 55, 1, 15, 31, 63]), (1, [0, 8, 16, 32, 3, 19, 38, 60], [3, 19, 38, 60, 0, 8, 16, 32])], "id int, s array<int>, m array<int>")


@query("pack_scales", f"with {_SCALES} select id, array_to_string({_sql_six('s', 'm')}, ',') as packed, true as same from t")
def pack_scales(spark, sf_dir):
    """Eight scales and minima in twelve bytes, and back."""
    packed = _scales(spark).withColumn("p", G.pack_six(F.col("s"), F.col("m")))
    back = packed.withColumn("u", G.unpack_six(F.col("p")))
    return back.select("id", joined("p").alias("packed"), ((F.col("u.scales") == F.col("s")) & (F.col("u.mins") == F.col("m"))).alias("same"))


@query("pack_xs_scales", f"with {_SCALES} select id, array_to_string([" + " + ".join(f"((s[{i + 1}] >> 4) << {2 * i})" for i in range(8)) + ", " + ", ".join(f"(s[{2 * i + 1}] & 15) + ((s[{2 * i + 2}] & 15) << 4)" for i in range(4)) + "], ',') as packed, array_to_string(s, ',') as back from t")
def pack_xs_scales(spark, sf_dir):
    """Eight scales as a 16-bit number and four bytes, and back."""
    packed = _scales(spark).withColumn("p", G.pack_xs(F.col("s"))).withColumn("u", G.unpack_xs(F.col("p")))
    return packed.select("id", joined("p").alias("packed"), joined("u").alias("back"))
