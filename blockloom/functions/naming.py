"""Names: tensors, architectures, types, planes, shards, sizes.  Look-ups are map literals, so Catalyst folds them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dims import ALIASES, GGUF_TYPES

#: Whole names, and the parts that follow a layer's number.
WHOLE = {"model.embed_tokens.weight": "token_embd.weight", "lm_head.weight": "output.weight", "model.norm.weight": "output_norm.weight"}
LAYER = {
    "self_attn.q_proj": "attn_q", "self_attn.k_proj": "attn_k", "self_attn.v_proj": "attn_v", "self_attn.o_proj": "attn_output",
    "mlp.gate_proj": "ffn_gate", "mlp.up_proj": "ffn_up", "mlp.down_proj": "ffn_down", "input_layernorm": "attn_norm", "post_attention_layernorm": "ffn_norm",
    "mlp.gate": "ffn_gate_inp", "block_sparse_moe.gate": "ffn_gate_inp",
    "mlp.shared_experts.gate_proj": "ffn_gate_shexp", "mlp.shared_experts.up_proj": "ffn_up_shexp", "mlp.shared_experts.down_proj": "ffn_down_shexp",
}
EXPERT = {"mlp.experts": {"gate_proj": "ffn_gate", "up_proj": "ffn_up", "down_proj": "ffn_down"}, "block_sparse_moe.experts": {"w1": "ffn_gate", "w2": "ffn_down", "w3": "ffn_up"}}

#: Architecture names that have one form.
ARCHITECTURES = {
    "llama": ("llama", "llama2", "llama3", "mistral", "mixtral", "kimi_vl", "kimi"),
    "qwen2": ("qwen2", "qwen", "qwen2_vl"),
    "phi3": ("phi", "phi3", "phi-3"),
    "gemma": ("gemma", "gemma2"),
    "deepseek2": ("deepseek", "deepseek2", "deepseek_v2"),
}


def lookup(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def container_name(name: Column) -> Column:
    """The container's name of a source tensor; names that no rule knows stay."""
    layer = F.regexp_extract(name, r"^model\.layers\.([^.]*)\.", 1)
    part = F.regexp_extract(name, r"^model\.layers\.[^.]*\.(.*)$", 1)
    bare = F.regexp_extract(part, r"^(.*)\.weight$", 1)
    expert = r"^(mlp\.experts|block_sparse_moe\.experts)\.([0-9]+)\.([a-z0-9_]+)\.weight$"
    experts = {f"{family}/{k}": v for family, parts in EXPERT.items() for k, v in parts.items()}
    known = lookup(experts, F.concat_ws("/", F.regexp_extract(part, expert, 1), F.regexp_extract(part, expert, 3)))
    number = F.regexp_extract(part, expert, 2).try_cast("long").cast("string")
    inside = F.coalesce(F.concat(known, F.lit("."), number, F.lit(".weight")), F.concat(lookup(LAYER, bare), F.lit(".weight")), part)
    return F.coalesce(lookup(WHOLE, name), F.when(F.contains(F.substring(name, 14, 10_000), F.lit(".")) & F.startswith(name, F.lit("model.layers.")), F.concat(F.lit("blk."), layer, F.lit("."), inside)), name)


def architecture(name: Column) -> Column:
    low = F.lower(name)
    return F.coalesce(lookup({old: new for new, olds in ARCHITECTURES.items() for old in olds}, low), low)


def quant_type(name: Column) -> Column:
    """Canonical type, or null for what can't be made."""
    up = F.upper(name)
    return F.coalesce(lookup(ALIASES, up), lookup({t: t for t in GGUF_TYPES}, up))


def container_type(quant: Column) -> Column:
    """S, M and L variants share a type in the container."""
    return F.regexp_replace(quant, "^(Q[2-6]_K)_[SML]$", "$1")


def bytes_text(n: Column) -> Column:
    """A size with two decimals; the exact quotient is rounded, halves to the even digit."""
    whole = n.cast("double").cast("long")  # sizes beyond 2 ** 53 count as doubles

    def unit(bits: int, name: str) -> Column:
        rest = whole.bitwiseAND((1 << bits) - 1) * 100
        cents, left = F.shiftright(rest, bits), rest.bitwiseAND((1 << bits) - 1)
        up = (left > 1 << bits - 1) | (left == 1 << bits - 1) & (cents % 2 == 1)
        total = cents + up.cast("long")  # 100 where it carries
        return F.concat((F.shiftright(whole, bits) + F.floor(total / 100)).cast("string"), F.lit("."), F.lpad((total % 100).cast("string"), 2, "0"), F.lit(name))

    return F.when(n >= 1 << 30, unit(30, " GB")).when(n >= 1 << 20, unit(20, " MB")).when(n >= 1 << 10, unit(10, " KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def plane_name(name: Column, plane: Column, planes: Column) -> Column:
    return F.when(planes > 1, F.concat(name, F.lit("["), plane.cast("string"), F.lit("]"))).otherwise(name)


def plane_id(base: Column, plane: Column, planes: Column) -> Column:
    return F.when(planes > 1, F.concat(base, F.lit("_"), plane.cast("string"))).otherwise(base)


def tensor_id(name: Column) -> Column:
    """An id that depends on the name alone, in the form of a uuid."""
    h = F.md5(name)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def shard_file(stem: Column, index: Column) -> Column:
    """Name of shard ``index``, counted from 0."""
    return F.format_string("%s-%05d.gguf", stem, index + 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
