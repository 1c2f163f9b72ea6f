"""Names, vocabularies, catalogs and dynamic programs over the test tables, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import naming as N
from ..operators import catalog as K
from ..operators import stats as T
from ..operators import tokens as V
from ..operators import trellis as R
from .matrix_queries import joined
from .relations import emb256, embz, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return keep


NAMES = [
    "model.embed_tokens.weight", "lm_head.weight", "model.norm.weight", "model.layers.0.self_attn.q_proj.weight", "model.layers.12.self_attn.o_proj.weight", "model.layers.3.mlp.gate_proj.weight",
    "model.layers.3.mlp.down_proj.weight", "model.layers.7.input_layernorm.weight", "model.layers.7.post_attention_layernorm.weight", "model.layers.1.mlp.gate.weight", "model.layers.1.block_sparse_moe.gate.weight",
    "model.layers.2.mlp.shared_experts.up_proj.weight", "model.layers.2.mlp.experts.15.down_proj.weight", "model.layers.4.block_sparse_moe.experts.07.w1.weight", "model.layers.4.block_sparse_moe.experts.7.w2.weight",
    "model.layers.4.block_sparse_moe.experts.7.w3.weight", "model.layers.5.self_attn.rotary.inv_freq", "vision.patch.weight", "model.layers.9",
]


def _values(items: list[str]) -> str:
    return ", ".join("('" + x.replace("'", "''") + "')" for x in items)


@query(
    "gguf_names",
    f"""with n as (select * from (values {_values(NAMES)}) t(name)),
p as (select name, regexp_extract(name, '^model\\.layers\\.([^.]*)\\.(.*)$', 1) as layer, regexp_extract(name, '^model\\.layers\\.([^.]*)\\.(.*)$', 2) as part from n),
x as (select *, regexp_extract(part, '^(mlp|block_sparse_moe)\\.experts\\.([0-9]+)\\.(\\w+)\\.weight$', 2) as e, regexp_extract(part, '^(mlp|block_sparse_moe)\\.experts\\.([0-9]+)\\.(\\w+)\\.weight$', 3) as w from p)
select name, case when name = 'model.embed_tokens.weight' then 'token_embd.weight' when name = 'lm_head.weight' then 'output.weight' when name = 'model.norm.weight' then 'output_norm.weight'
when part = '' then name else 'blk.' || layer || '.' || case
when e <> '' and w in ('gate_proj', 'w1') then 'ffn_gate.' || cast(e as bigint) || '.weight' when e <> '' and w in ('up_proj', 'w3') then 'ffn_up.' || cast(e as bigint) || '.weight' when e <> '' and w in ('down_proj', 'w2') then 'ffn_down.' || cast(e as bigint) || '.weight'
when part in ('mlp.gate.weight', 'block_sparse_moe.gate.weight') then 'ffn_gate_inp.weight'
when part like 'mlp.shared_experts.%' then 'ffn_' || regexp_extract(part, 'experts\\.(\\w+)_proj', 1) || '_shexp.weight'
when part = 'self_attn.o_proj.weight' then 'attn_output.weight' when part like 'self_attn._\\_proj.weight' escape '\\' then 'attn_' || substr(part, 11, 1) || '.weight'
when part like 'mlp.%\\_proj.weight' escape '\\' then 'ffn_' || regexp_extract(part, 'mlp\\.(\\w+)_proj', 1) || '.weight'
when part = 'input_layernorm.weight' then 'attn_norm.weight' when part = 'post_attention_layernorm.weight' then 'ffn_norm.weight' else part end end as container_name from x""",
)
def gguf_names(spark, sf_dir) -> DataFrame:
    return spark.createDataFrame([(n,) for n in NAMES], "name string").withColumn("container_name", N.container_name(F.col("name")))


@query("arch_norm", "select name, case when lower(name) in ('llama', 'llama2', 'llama3', 'mistral', 'mixtral', 'kimi_vl', 'kimi') then 'llama' when lower(name) in ('qwen', 'qwen2', 'qwen2_vl') then 'qwen2' when lower(name) in ('phi', 'phi3', 'phi-3') then 'phi3' when lower(name) in ('gemma', 'gemma2') then 'gemma' when lower(name) in ('deepseek', 'deepseek2', 'deepseek_v2') then 'deepseek2' else lower(name) end as architecture from (values ('Llama'), ('MIXTRAL'), ('qwen2_vl'), ('Phi-3'), ('gemma2'), ('DeepSeek_V2'), ('kimi'), ('Falcon')) t(name)")
def arch_norm(spark, sf_dir):
    names = spark.createDataFrame([(n,) for n in ("Llama", "MIXTRAL", "qwen2_vl", "Phi-3", "gemma2", "DeepSeek_V2", "kimi", "Falcon")], "name string")
    return names.withColumn("architecture", N.architecture(F.col("name")))


_KNOWN = "'F32','F16','Q4_0','Q4_1','Q5_0','Q5_1','Q8_0','Q2_K','Q3_K_S','Q3_K_M','Q3_K_L','Q4_K_S','Q4_K_M','Q5_K_S','Q5_K_M','Q6_K','IQ4_XS','IQ4_NL'"
_TYPED = ("q4_k_m", "Q4_K", "q3_k", "Q5_k", "iq4_nl", "IQ2_XS", "q8_0", "f16", "nonsense", "q6_K")


@query("quant_types", f"with t as (select name, upper(name) as u from (values {_values(list(_TYPED))}) t(name)), c as (select name, case when u in ('Q3_K', 'Q4_K', 'Q5_K') then u || '_M' when u in ({_KNOWN}) then u end as quant_type from t) select name, quant_type, regexp_replace(quant_type, '^(Q[2-6]_K)_[SML]$', '\\1') as container_type from c")
def quant_types(spark, sf_dir):
    t = spark.createDataFrame([(n,) for n in _TYPED], "name string").withColumn("quant_type", N.quant_type(F.col("name")))
    return t.withColumn("container_type", N.container_type(F.col("quant_type")))


@query("format_bytes", "select n_bytes, case when n_bytes >= 1073741824 then printf('%.2f GB', n_bytes / 1073741824e0) when n_bytes >= 1048576 then printf('%.2f MB', n_bytes / 1048576e0) when n_bytes >= 1024 then printf('%.2f KB', n_bytes / 1024e0) else n_bytes || ' B' end as shown from (select distinct cast(length(html) as bigint) * length(html) * (page_id % 40 + 1) as n_bytes from pages)")
def format_bytes(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select((F.length("html").cast("long") * F.length("html") * (F.col("page_id") % 40 + 1)).alias("n_bytes")).distinct()
    return p.withColumn("shown", N.bytes_text(F.col("n_bytes")))


@query("path_parts", "select page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') as stem, printf('%s-%05d.gguf', 'model', page_id + 1) as shard_file from pages")
def path_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", N.stem(F.col("url")).alias("stem"), N.shard_file(F.lit("model"), F.col("page_id")).alias("shard_file"))


# ---- vocabularies ------------------------------------------------------------------------

_WORDS = "w as (select distinct unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as token from benchmark), v as (select token, row_number() over (order by token) - 1 as id from w where token <> '')"


def _words(spark, sf_dir) -> DataFrame:
    """A vocabulary of the benchmark's words; ids by rank, through a file of the usual form."""
    b = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("token")).where("token <> ''").distinct()
    one = b.agg(F.array_sort(F.collect_set("token")).alias("t"))
    return one.select(F.to_json(F.struct(F.struct(F.lit("WordLevel").alias("type"), F.map_from_arrays("t", F.sequence(F.lit(0), F.size("t") - 1)).alias("vocab")).alias("model"))).alias("value"))


def _tokens(spark, sf_dir) -> DataFrame:
    specials = spark.createDataFrame([('{"bos_token": "the", "eos_token": {"content": "and"}, "unk_token": "of", "pad_token": null, "tokenizer_class": "to", "extra_token": 5}',)], "value string")
    return V.with_specials(V.vocabulary(_words(spark, sf_dir)).select("token", "id", "score"), V.special_tokens(specials))


_SPECIAL = "case token when 'the' then 'bos_token' when 'and' then 'eos_token' when 'of' then 'unk_token' end"


@query("vocab_table", f"with {_WORDS} select id, token, id as embedding_row, coalesce({_SPECIAL} is not null, false) as special, coalesce({_SPECIAL}, '') as special_type, 0e0 as score from v")
def vocab_table(spark, sf_dir):
    return _tokens(spark, sf_dir)


@query("vocab_size", f"with {_WORDS} select count(*) as vocab_size, max(id) as last_id from v")
def vocab_size(spark, sf_dir):
    return _tokens(spark, sf_dir).agg(F.count(F.lit(1)).alias("vocab_size"), F.max("id").alias("last_id"))


@query("token_types", f"with {_WORDS}, all_tokens as (select token, {_SPECIAL} as s from v union all select '<0x0A>', null union all select '<0x41', null) select token, case when s like '%unk%' then 2 when s is not null then 3 when token like '<0x%>' then 6 else 1 end as token_type from all_tokens")
def token_types(spark, sf_dir):
    t = _tokens(spark, sf_dir).select("token", "special", "special_type")
    t = t.unionByName(spark.createDataFrame([("<0x0A>", False, ""), ("<0x41", False, "")], "token string, special boolean, special_type string"))
    return t.select("token", V.token_type(F.col("special"), F.col("special_type"), F.col("token")).alias("token_type"))


@query("special_ids", f"with {_WORDS} select case token when 'the' then 'tokenizer.ggml.bos_token_id' when 'and' then 'my.eos' end as key, id from v where token in ('the', 'and')")
def special_ids(spark, sf_dir):
    return V.special_ids(_tokens(spark, sf_dir), {"eos": "my.eos", "unk": ""})


@query("tokenizer_meta", f"""with {_WORDS} select 'tokenizer.ggml.model' as key, '"gpt2"' as value union all select 'tokenizer.ggml.tokens', '[' || string_agg('"' || token || '"', ',' order by id) || ']' from v union all select 'tokenizer.ggml.scores', '[' || string_agg('0.0', ',' order by id) || ']' from v
union all select 'tokenizer.ggml.token_type', '[' || string_agg(case when token = 'of' then '2' when token in ('the', 'and') then '3' else '1' end, ',' order by id) || ']' from v
union all select case token when 'the' then 'tokenizer.ggml.bos_token_id' when 'and' then 'tokenizer.ggml.eos_token_id' else 'tokenizer.ggml.unknown_token_id' end, cast(id as varchar) from v where token in ('the', 'and', 'of')""")
def tokenizer_meta(spark, sf_dir):
    return V.container_entries(_tokens(spark, sf_dir), "WordLevel")


@query("unigram_vocab", "with e as (select event_type, count(*) as n from events group by event_type) select event_type as token, row_number() over (order by event_type) - 1 as id, -cast(n as double) as score from e")
def unigram_vocab(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("event_type").count()
    pairs = e.agg(F.array_sort(F.collect_list(F.struct("event_type", F.concat(F.lit("-"), F.col("count").cast("string")).alias("n")))).alias("p"))
    text = pairs.select(F.concat(F.lit('{"model": {"type": "Unigram", "vocab": '), F.to_json(F.transform("p", lambda x: F.array(x["event_type"], x["n"]))), F.lit("}}")).alias("value"))
    return V.vocabulary(text).select("token", "id", "score")


@query("rank_lines", "with t as (select item_id, regexp_extract(text, '^\\S+', 0) as w from benchmark) select w as token, cast(item_id as bigint) as id from t where item_id % 3 <> 0")
def rank_lines(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract("text", r"^\S+", 0).alias("w"))
    good = F.concat_ws(" ", F.base64(F.encode("w", "UTF-8")), F.col("item_id").cast("string"))
    lines = b.select(F.when(F.col("item_id") % 3 != 0, good).when(F.col("item_id") % 2 == 0, F.lit("not a line")).otherwise(F.lit("b64 x")).alias("value"))
    return V.rank_lines(lines)


# ---- catalogs -----------------------------------------------------------------------------------

_DTYPES = "(case part.p_partkey % 5 when 0 then 'F32' when 1 then 'F16' when 2 then 'BF16' when 3 then 'I8' else 'XX' end)"
_SHAPE = "(case p_partkey % 4 when 0 then [p_partkey] when 1 then [p_partkey, p_size] when 2 then [2, p_size, 64] else [2, 3, p_size, 32] end)"
_CATALOG = f"c as (select 'model.layers.' || p_partkey || '.mlp.up_proj.weight' as name, p_partkey as k, {_DTYPES} as dtype, {_SHAPE} as shape, list_product({_SHAPE}) as n from part)"


def _catalog(spark, sf_dir) -> DataFrame:
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    two, three = F.lit(2).cast("long"), F.lit(3).cast("long")
    shape = F.when(k % 4 == 0, F.array(k)).when(k % 4 == 1, F.array(k, s)).when(k % 4 == 2, F.array(two, s, F.lit(64).cast("long"))).otherwise(F.array(two, three, s, F.lit(32).cast("long")))
    dtype = F.when(k % 5 == 0, "F32").when(k % 5 == 1, "F16").when(k % 5 == 2, "BF16").when(k % 5 == 3, "I8").otherwise("XX")
    return table(spark, sf_dir, "part").select(F.format_string("model.layers.%d.mlp.up_proj.weight", k).alias("name"), k.alias("k"), dtype.alias("dtype"), shape.alias("shape"))


@query("tensor_stats", f"with {_CATALOG} select count(*) as tensors, cast(sum(n) as bigint) as elements, cast(sum(n * case dtype when 'F16' then 2 when 'BF16' then 2 when 'I8' then 1 else 4 end) as bigint) as bytes, count(case when len(shape) = 1 then 1 end) as rank_1, count(case when len(shape) = 2 then 1 end) as rank_2, count(case when len(shape) = 3 then 1 end) as rank_3, count(case when len(shape) > 3 then 1 end) as rank_4_up, cast(min(n) as bigint) as least, cast(max(n) as bigint) as greatest from c")
def tensor_stats(spark, sf_dir):
    return T.tensor_stats(_catalog(spark, sf_dir))


@query("dtype_histogram", f"with {_CATALOG} select dtype, count(*) as count from c group by dtype")
def dtype_histogram(spark, sf_dir):
    return T.dtype_histogram(_catalog(spark, sf_dir))


_UUID = "substr(md5(name), 1, 8) || '-' || substr(md5(name), 9, 4) || '-' || substr(md5(name), 13, 4) || '-' || substr(md5(name), 17, 4) || '-' || substr(md5(name), 21, 12)"
_PLANES = f"{_CATALOG}, d as (select *, case when len(shape) > 2 then cast(list_product(shape[1:len(shape) - 2]) as bigint) else 1 end as planes, {_UUID} as base from c), p as (select *, unnest(range(0, planes)) as plane from d)"


@query("tensor_planes", f"with {_PLANES} select case when planes > 1 then name || '[' || plane || ']' else name end as plane_name, case when planes > 1 then base || '_' || plane else base end as uuid, cast(case when len(shape) = 1 then shape[1] else shape[len(shape) - 1] end as bigint) as rows, cast(case when len(shape) = 1 then 1 else shape[len(shape)] end as bigint) as cols from p")
def tensor_planes(spark, sf_dir):
    return K.planes(_catalog(spark, sf_dir)).select("plane_name", "uuid", "rows", "cols")


@query("nd_reassembly", f"with {_PLANES} select name, cast(count(*) as integer) as num_planes, string_agg(case when planes > 1 then base || '_' || plane else base end, ',' order by plane) as uuids from p group by name")
def nd_reassembly(spark, sf_dir):
    return K.name_map(K.planes(_catalog(spark, sf_dir))).select("name", "num_planes", F.array_join("plane_uuids", ",").alias("uuids"))


@query("tensor_metadata", f"with {_PLANES} select case when planes > 1 then base || '_' || plane else base end as uuid, dtype as original_dtype, '[' || array_to_string(shape, ',') || ']' as original_shape, case when planes > 1 then cast(plane as varchar) end as plane_index, case when planes > 1 then 5 else 3 end as n from p")
def tensor_metadata(spark, sf_dir):
    m = K.tensor_metadata(K.planes(_catalog(spark, sf_dir)))
    at = lambda k: F.element_at("metadata", F.lit(k)).alias(k)
    return m.select("uuid", at("original_dtype"), at("original_shape"), at("plane_index"), F.size("metadata").alias("n"))


@query("dtype_dedup", f"with {_CATALOG} select dtype, min(name) as first_name, max(n) as most from (select dtype, name, cast(n as bigint) as n from c) group by dtype")
def dtype_dedup(spark, sf_dir):
    c = _catalog(spark, sf_dir).withColumn("n", T.elements_of(F.col("shape")))
    return c.groupBy("dtype").agg(F.min("name").alias("first_name"), F.max("n").alias("most"))


_PLAN = f"""{_CATALOG},
o as (select *, case when k % 7 = 0 then 'q6_k' when k % 11 = 0 then 'iq2_xs' when k % 13 = 0 then 'Q4_0' end as wanted, case when len(shape) = 1 then 1 else shape[len(shape)] end as cols from c),
t as (select *, case when wanted is null then 'Q4_K_M' when upper(wanted) in ({_KNOWN}) then upper(wanted) end as type from o),
a as (select *, case when type is null then null when type in ('Q4_K_M', 'Q6_K') and cols % 256 = 0 then type when type in ('Q4_K_M', 'Q6_K') and cols % 32 = 0 then 'Q8_0' when type = 'Q4_0' and cols % 32 = 0 then type else 'F16' end as actual from t),
b as (select *, cast(case actual when 'F16' then n * 2 when 'Q8_0' then n // 32 * 34 when 'Q4_0' then n // 32 * 18 when 'Q4_K_M' then n // 256 * 144 when 'Q6_K' then n // 256 * 210 end as bigint) as bytes from a)"""


def _plan(spark, sf_dir) -> DataFrame:
    c = _catalog(spark, sf_dir)
    o = c.select("name", F.when(F.col("k") % 7 == 0, "q6_k").when(F.col("k") % 11 == 0, "iq2_xs").when(F.col("k") % 13 == 0, "Q4_0").alias("wanted")).where("wanted is not null")
    return K.export_plan(c, o, "q4_k_m")


@query("export_plan", f"with {_PLAN} select name, 'blk.' || k || '.ffn_up.weight' as container_name, wanted, actual, regexp_replace(actual, '_[SML]$', '') as container_type, coalesce(bytes, -1) as bytes, case when type is null then 'unknown type ' || wanted end as error from b")
def export_plan(spark, sf_dir):
    return _plan(spark, sf_dir).fillna(-1, ["bytes"])


@query("shard_assign", f"with recursive {_PLAN}, s as (select k as ordinal, bytes, row_number() over (order by k) as i from b where bytes is not null), f(i, used, shard, ordinal, bytes) as (select i, bytes, 0, ordinal, bytes from s where i = 1 union all select s.i, case when f.used > 0 and f.used + s.bytes > 200000 then s.bytes else f.used + s.bytes end, case when f.used > 0 and f.used + s.bytes > 200000 then f.shard + 1 else f.shard end, s.ordinal, s.bytes from f join s on s.i = f.i + 1) select ordinal, bytes, shard from f")
def shard_assign(spark, sf_dir):
    k = F.regexp_extract("name", r"layers\.(\d+)\.", 1).cast("long")
    p = _plan(spark, sf_dir).where("bytes is not null").select(k.alias("ordinal"), "bytes")
    return K.assign_shards(p, 200_000)


@query("export_stats", f"with {_PLAN}, i as (select actual as quant_type, (k % 10) / 10e0 as importance from b where actual is not null) select quant_type, count(*) as tensors, min(importance) as min_importance, round(avg(importance), 6) as avg_importance, max(importance) as max_importance, round(100e0 * count(*) / (select count(*) from i), 6) as percent from i group by quant_type")
def export_stats(spark, sf_dir):
    k = F.regexp_extract("name", r"layers\.(\d+)\.", 1).cast("long")
    a = _plan(spark, sf_dir).where("actual is not null").select(F.col("actual").alias("quant_type"), (k % 10 / 10.0).alias("importance"))
    return T.export_stats(a).withColumn("avg_importance", F.round("avg_importance", 6)).withColumn("percent", F.round("percent", 6))


@query("name_join", f"with {_CATALOG}, m as (select 'model.layers.' || s_suppkey * 3 || '.mlp.up_proj.weight' as name, s_suppkey % 2 = 0 as include from supplier) select c.name, c.dtype from c join m on c.name = m.name where m.include")
def name_join(spark, sf_dir):
    """Scanned tensors joined with those a map includes."""
    m = table(spark, sf_dir, "supplier").select(F.format_string("model.layers.%d.mlp.up_proj.weight", F.col("s_suppkey") * 3).alias("name"), (F.col("s_suppkey") % 2 == 0).alias("include"))
    return _catalog(spark, sf_dir).join(m.where("include"), "name").select("name", "dtype")


@query("model_config_alias", "with e as (select event_id as k from events) select k, case k % 3 when 0 then 'llama' when 1 then 'qwen2' else 'bloom' end as architecture, 1000 + k as vocab_size, k % 100 as hidden_size, case when k % 2 = 0 then k % 7 else -1 end as num_layers from e")
def model_config_alias(spark, sf_dir):
    return _configs(spark, sf_dir).fillna(-1, ["num_layers"])


def _configs(spark, sf_dir) -> DataFrame:
    kind = F.when(F.col("event_id") % 3 == 0, "Mistral").when(F.col("event_id") % 3 == 1, "qwen").otherwise("Bloom")
    hidden = (F.col("event_id") % 100).cast("string")
    layers = (F.col("event_id") % 7).cast("string")
    text = F.concat(F.lit('{"model_type": "'), kind, F.lit('", "vocab_size": '), (F.col("event_id") + 1000).cast("string"), F.lit(', "d_model": 7, "text_config": {"hidden_size": '), hidden, F.when(F.col("event_id") % 2 == 0, F.concat(F.lit(', "n_layer": '), layers)).otherwise(F.lit("")), F.lit("}}"))
    configs = table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), text.alias("value"))
    return K.model_config(configs).select("k", "architecture", "vocab_size", "hidden_size", "num_layers")


@query("container_metadata", "with e as (select event_id as k from events), m as (select case k % 3 when 0 then 'llama' when 1 then 'qwen2' else 'bloom' end as a, k from e) select a as architecture, a || '.vocab_size' as key, cast(1000 + k as varchar) as value from m union all select a, a || '.embedding_length', cast(k % 100 as varchar) from m union all select a, a || '.block_count', cast(k % 7 as varchar) from m where k % 2 = 0 union all select a, 'general.architecture', a from m")
def container_metadata(spark, sf_dir):
    m = _configs(spark, sf_dir)
    for c in ("num_attention_heads", "intermediate_size", "max_position_embeddings"):
        m = m.withColumn(c, F.lit(None).cast("long"))
    return K.container_metadata(m)


@query("metadata_note", "select event_id, 'B8x8' as block_format, case when event_id % 2 = 0 then 'first; encoded' else 'encoded' end as conversion_info, case when event_id % 2 = 0 then 3 else 3 end as n from events")
def metadata_note(spark, sf_dir):
    old = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("conversion_info"), F.lit("first"), F.lit("a"), F.lit("1"))).otherwise(F.create_map(F.lit("block_format"), F.lit("B8x4"), F.lit("a"), F.lit("1")))
    new = K.next_metadata(old, "B8x8", "encoded")
    e = table(spark, sf_dir, "events").withColumn("m", new)
    return e.select("event_id", F.element_at("m", F.lit("block_format")).alias("block_format"), F.element_at("m", F.lit("conversion_info")).alias("conversion_info"), F.size("m").alias("n"))


@query("json_props", "select event_type, count(json_extract_string(props, '$.k')) + count(*) as n from events group by event_type")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg((F.count(F.get_json_object("props", "$.k")) + F.count(F.lit(1))).alias("n"))


# ---- dynamic programs -------------------------------------------------------------------------------


@query("topk_states", "with m as (select vec_id as r, generate_subscripts(embedding, 1) - 1 as c, least(abs(cast(unnest(embedding) as double)) * 3, 1e0) as o from embeddings), s as (select r, c, s, row_number() over (partition by r, c order by (o - s / 15e0) * (o - s / 15e0), s) as k from m, (select unnest(range(0, 16)) as s)) select r as row, cast(c as integer) as col, string_agg(cast(s as varchar), ',' order by k) as states from s where k <= 8 group by r, c")
def topk_states(spark, sf_dir):
    """The eight nearest states of each element, nearest first."""
    from ..operators.trellis import KEPT, STATES
    from .relations import emb

    flat = emb(spark, sf_dir).select("row", F.posexplode("values").alias("col", "v")).withColumn("o", F.least(F.abs("v") * 3, F.lit(1.0)))
    err = F.transform(F.sequence(F.lit(0), F.lit(STATES - 1)), lambda s: F.struct(((F.col("o") - s / 15.0) * (F.col("o") - s / 15.0)).alias("e"), s.alias("s")))
    return flat.select("row", "col", F.array_join(F.transform(F.slice(F.array_sort(err), 1, KEPT), lambda x: x["s"].cast("string")), ",").alias("states"))


@query("trellis_scales")
def trellis_scales(spark, sf_dir):
    return R.superblock_scales(emb256(spark, sf_dir)).select("row", "sb", joined("scales").alias("scales"))


@query("trellis_single")
def trellis_single(spark, sf_dir):
    return R.trellis_single(embz(spark, sf_dir)).select("row", "block", F.round("scale", 6).alias("scale"), "signs", joined("states").alias("states"))


@query("trellis_dual")
def trellis_dual(spark, sf_dir):
    d = R.trellis_dual(embz(spark, sf_dir))
    return d.select("pair", "block", F.round("scale", 6).alias("scale"), joined("states_a").alias("states_a"), joined("states_b").alias("states_b"), "redundant")
