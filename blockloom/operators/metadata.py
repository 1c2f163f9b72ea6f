"""Metadata as maps of JSON values: typed access, entries of model folders, what tensor files say of themselves.

A map has the JSON text of each value, so that 1, "1" and true stay apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What is taken from a tensor file's own metadata.
CONFIG_KEYS = ("architecture", "vocab_size", "hidden_size", "num_layers", "num_hidden_layers", "num_attention_heads", "intermediate_size", "max_position_embeddings", "model_type", "torch_dtype")


def text(value: Column) -> Column:
    """The JSON text of a string."""
    return F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)


def from_json(value: Column) -> Column:
    """The map of a JSON object's text."""
    return F.transform_values(F.from_json(value, "map<string,variant>"), lambda _, v: F.to_json(v))


def to_json(metadata: Column) -> Column:
    """A JSON object's text, its keys sorted."""
    entries = F.array_sort(F.map_entries(metadata))
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(text(e["key"]), F.lit(":"), e["value"])), ","), F.lit("}"))


def get(metadata: Column, key: str) -> Column:
    return F.element_at(metadata, F.lit(key))


def get_str(metadata: Column, key: str) -> Column:
    v = get(metadata, key)
    return F.when(F.startswith(v, F.lit('"')), F.get(F.from_json(F.concat(F.lit("["), v, F.lit("]")), "array<string>"), F.lit(0)))


def get_long(metadata: Column, key: str) -> Column:
    v = get(metadata, key)
    return F.when(v.rlike("^-?[0-9]+$"), v.try_cast("long"))


def get_unsigned(metadata: Column, key: str) -> Column:
    """As a decimal, which holds all 64 bits."""
    v = get(metadata, key)
    return F.when(v.rlike("^[0-9]+$") & (v.try_cast("decimal(38,0)") < F.lit("18446744073709551616").cast("decimal(38,0)")), v.try_cast("decimal(20,0)"))


def get_double(metadata: Column, key: str) -> Column:
    v = get(metadata, key)
    return F.when(v.rlike(r"^-?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?$"), v.try_cast("double"))


def get_bool(metadata: Column, key: str) -> Column:
    v = get(metadata, key)
    return F.when(v == "true", True).when(v == "false", False)


def put(metadata: Column, key: str, value: Column, kind: str) -> Column:
    """The map with one more value of kind string, long, double or boolean; numbers that aren't finite change nothing."""
    made = text(value) if kind == "string" else value.cast("string")
    entry = F.map_concat(remove(metadata, key), F.create_map(F.lit(key), made))
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), metadata).otherwise(entry) if kind == "double" else entry


def remove(metadata: Column, key: str) -> Column:
    return F.map_filter(metadata, lambda k, _: k != key)


def contains(metadata: Column, key: str) -> Column:
    return F.map_contains_key(metadata, key)


def from_strings(values: Column) -> Column:
    """A map of plain strings."""
    return F.transform_values(values, lambda _, v: text(v))


def tensor_entries(files: DataFrame) -> DataFrame:
    """(name, uuid, plane, num_planes, original_shape, matrix_shape) of metadata JSON in column ``value``.

    An entry of ``tensor_name_map`` is an id (a matrix) or an object with shapes and the
    ids of its planes; objects without one of them, and other entries, are left out.
    """
    carried = [c for c in files.columns if c != "value"]
    entries = files.select(*carried, F.explode(F.from_json(F.get_json_object("value", "$.tensor_name_map"), "map<string,string>")).alias("name", "v"))
    planes = F.from_json("v", "original_shape array<bigint>, matrix_shape array<bigint>, plane_uuids array<string>")
    entries = entries.withColumn("p", F.when(F.startswith("v", F.lit("{")), planes))
    whole = F.col("p.original_shape").isNotNull() & (F.size("p.matrix_shape") >= 2) & F.col("p.plane_uuids").isNotNull()
    ids = F.when(F.col("p").isNull(), F.array("v")).when(whole, F.col("p.plane_uuids"))
    flat = entries.where("v is not null and not startswith(v, '[')").select(*carried, "name", "p", F.size(ids).alias("num_planes"), F.posexplode(ids).alias("plane", "uuid"))
    return flat.select(*carried, "name", "uuid", "plane", "num_planes", F.col("p.original_shape").alias("original_shape"), F.slice("p.matrix_shape", 1, 2).alias("matrix_shape"))


def entry_by_uuid(entries: DataFrame, uuids: DataFrame) -> DataFrame:
    """The entries whose tensor has one of ``uuids(uuid)`` among its planes."""
    names = entries.join(uuids.select("uuid").distinct(), "uuid", "left_semi").select("name").distinct()
    return entries.join(names, "name", "left_semi")


def file_metadata(headers: DataFrame, tensor: str | None = None) -> DataFrame:
    """``metadata`` of tensor files whose header JSON is in column ``value``.

    The dtype is that of ``tensor``, or else of the first tensor by its place in the file;
    of the file's own metadata the ``CONFIG_KEYS`` are kept, as JSON where they are such.
    """
    members = F.from_json("value", "map<string,string>")
    tensors = F.map_filter(members, lambda k, _: k != "__metadata__")
    place = lambda e: F.get_json_object(e["value"], "$.data_offsets[0]").cast("long")
    if tensor is None:
        first = F.array_min(F.transform(F.map_entries(tensors), lambda e: F.struct(place(e).alias("at"), e["key"].alias("name"), F.get_json_object(e["value"], "$.dtype").alias("dtype"))))["dtype"]
    else:
        first = F.get_json_object(F.element_at(tensors, F.lit(tensor)), "$.dtype")
    own = F.from_json(F.get_json_object("value", "$.__metadata__"), "map<string,string>")
    kept = F.map_filter(F.coalesce(own, F.create_map().cast("map<string,string>")), lambda k, _: k.isin(*CONFIG_KEYS))
    typed = F.transform_values(kept, lambda _, v: F.coalesce(F.to_json(F.try_parse_json(v)), text(v)))
    base = F.create_map(F.lit("source_format"), F.lit('"safetensors"'), F.lit("original_dtype"), text(F.coalesce(first, F.lit("UNKNOWN"))), F.lit("created_at"), text(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")))
    return headers.select(*[c for c in headers.columns if c != "value"], F.map_concat(base, typed).alias("metadata"))
