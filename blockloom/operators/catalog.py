"""Catalog of tensors: planes, model configs, metadata, export plans and shards."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions.dims import GGUF_TYPES
from .stats import elements_of, fallback

#: Where a config may nest the text model, and other names of its fields.
NESTED = ("text_config", "language_config", "llm_config")
FIELDS = {
    "vocab_size": ("vocab_size",),
    "hidden_size": ("hidden_size", "d_model"),
    "num_layers": ("num_hidden_layers", "num_layers", "decoder_layers", "n_layer"),
    "num_attention_heads": ("num_attention_heads", "num_heads", "decoder_attention_heads", "n_head"),
    "intermediate_size": ("intermediate_size", "d_ff", "decoder_ffn_dim"),
    "max_position_embeddings": ("max_position_embeddings", "n_positions", "max_target_positions"),
}


def planes(catalog: DataFrame) -> DataFrame:
    """One row a plane: catalog(name, shape) to (name, plane_name, uuid, plane, planes, rows, cols, shape).

    A vector is a column of n rows; leading dimensions beyond two count planes.
    """
    rank = F.size("shape")
    rows = F.when(rank == 0, 1).when(rank == 1, F.get("shape", F.lit(0))).otherwise(F.get("shape", rank - 2))
    cols = F.when(rank <= 1, 1).otherwise(F.get("shape", rank - 1))
    count = F.when(rank > 2, F.aggregate(F.slice("shape", 1, F.greatest(rank - 2, F.lit(0))), F.lit(1).cast("long"), lambda a, n: a * n)).otherwise(1)
    df = catalog.withColumn("planes", count.cast("long")).withColumn("rows", rows.cast("long")).withColumn("cols", cols.cast("long"))
    df = df.withColumn("plane", F.explode(F.when(F.col("planes") > 0, F.sequence(F.lit(0).cast("long"), F.col("planes") - 1)).otherwise(F.array().cast("array<long>"))))
    base = N.tensor_id(F.col("name"))
    return df.withColumn("base_uuid", base).withColumn("uuid", N.plane_id(base, F.col("plane"), F.col("planes"))).withColumn("plane_name", N.plane_name(F.col("name"), F.col("plane"), F.col("planes")))


def name_map(plane_rows: DataFrame) -> DataFrame:
    """(name, num_planes, plane_uuids, total): planes grouped again by their tensor, in plane order."""
    base = F.regexp_replace("plane_name", r"\[.*", "")
    ordered = F.sort_array(F.collect_list(F.struct("plane", "uuid")))
    return plane_rows.groupBy(base.alias("name")).agg(ordered.alias("p")).select("name", F.size("p").alias("num_planes"), F.transform("p", lambda x: x["uuid"]).alias("plane_uuids"))


def model_config(configs: DataFrame) -> DataFrame:
    """(model_type, and the fields of FIELDS) from config JSON in column ``value``; nested text configs come first."""
    def field(names: tuple[str, ...]) -> Column:
        paths = [f"$.{p}{n}" for n in names for p in (*(f"{x}." for x in NESTED), "")]
        return F.coalesce(*[F.get_json_object("value", p).try_cast("long") for p in paths])

    kind = F.coalesce(F.get_json_object("value", "$.model_type"), F.get_json_object("value", "$.architecture"))
    return configs.select(*[c for c in configs.columns if c != "value"], N.architecture(kind).alias("architecture"), *[field(v).alias(k) for k, v in FIELDS.items()])


def container_metadata(models: DataFrame) -> DataFrame:
    """(key, value) of a model's known fields, prefixed by its architecture."""
    keys = {
        "vocab_size": "vocab_size", "hidden_size": "embedding_length", "num_layers": "block_count", "num_attention_heads": "attention.head_count",
        "intermediate_size": "feed_forward_length", "max_position_embeddings": "context_length",
    }
    arch = F.coalesce("architecture", F.lit("llama"))
    entries = F.create_map(*[x for f, k in keys.items() for x in (F.concat(arch, F.lit(f".{k}")), F.col(f).cast("string"))])
    flat = models.select("architecture", F.explode(F.map_concat(F.create_map(F.lit("general.architecture"), arch), F.map_filter(entries, lambda k, v: v.isNotNull()))).alias("key", "value"))
    return flat.select(arch.alias("architecture"), "key", "value")


def tensor_metadata(plane_rows: DataFrame) -> DataFrame:
    """(uuid, metadata): a map of what is known of each plane; unknown entries are left out."""
    many = F.col("planes") > 1
    whole = F.create_map(
        F.lit("source_tensor_name"), F.col("name"), F.lit("original_dtype"), F.col("dtype"), F.lit("original_shape"), F.to_json("shape"),
        F.lit("plane_index"), F.when(many, F.col("plane").cast("string")), F.lit("num_planes"), F.when(many, F.col("planes").cast("string")),
    )
    return plane_rows.select("uuid", F.map_filter(whole, lambda k, v: v.isNotNull()).alias("metadata"))


def quant_bytes(rows: Column, cols: Column, quant: Column) -> Column:
    size = N.lookup({t: b for t, (b, _) in GGUF_TYPES.items()}, quant)
    held = N.lookup({t: n for t, (_, n) in GGUF_TYPES.items()}, quant)
    return rows * F.ceil(cols / size) * held


def export_plan(catalog: DataFrame, overrides: DataFrame, default: str) -> DataFrame:
    """Per tensor: container name, wanted and actual type, bytes, and ``error`` for an override that can't be made.

    catalog(name, shape), overrides(name, wanted).
    """
    c = catalog.join(F.broadcast(overrides) if overrides.count() < 100_000 else overrides, "name", "left")
    wanted = N.quant_type(F.coalesce("wanted", F.lit(default)))
    rank = F.size("shape")
    cols = F.when(rank <= 1, 1).otherwise(F.get("shape", rank - 1)).cast("long")
    c = c.withColumn("cols", cols).withColumn("n", elements_of(F.col("shape"))).withColumn("type", wanted)
    c = c.withColumn("actual", fallback(F.col("cols"), F.col("type")))
    rows = F.floor(F.col("n") / F.greatest(F.col("cols"), F.lit(1)))
    return c.select("name", N.container_name(F.col("name")).alias("container_name"), "wanted", "actual", N.container_type(F.col("actual")).alias("container_type"), quant_bytes(rows, F.col("cols"), F.col("actual")).alias("bytes"), F.when(F.col("type").isNull(), F.concat(F.lit("unknown type "), F.col("wanted"))).alias("error"))


def assign_shards(sizes: DataFrame, most: int, order: str = "ordinal", size: str = "bytes") -> DataFrame:
    """Adds ``shard``: next-fit in order; a shard is closed when the next tensor would pass ``most``.

    Sequential by nature, so one task walks the sorted catalog of one model once:
    names and sizes of some 10,000 tensors, never tensor data.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used, shard = 0, 0
        for batch in batches:
            shards = []
            for n in batch.column(1).to_pylist():
                if used > 0 and used + n > most:
                    used, shard = 0, shard + 1
                used += n
                shards.append(shard)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shards, pa.int32())], names=[order, "shard"])

    narrow = sizes.select(F.col(order).cast("long").alias(order), F.col(size).cast("long").alias(size))
    made = narrow.repartition(1).sortWithinPartitions(order).mapInArrow(walk, f"{order} long, shard int")
    return sizes.join(made, order)


def next_metadata(existing: Column, fmt: str, note: str) -> Column:
    """A copy of a metadata map with the block format and one more conversion note."""
    notes = F.concat_ws("; ", F.element_at(existing, F.lit("conversion_info")), F.lit(note))
    rest = F.map_filter(existing, lambda k, v: ~k.isin("block_format", "conversion_info"))
    return F.map_concat(rest, F.create_map(F.lit("block_format"), F.lit(fmt), F.lit("conversion_info"), notes))
