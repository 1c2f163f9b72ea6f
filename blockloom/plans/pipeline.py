"""Import and export of models as DataFrame pipelines.

A stored model is a folder of Parquet tables: ``catalog`` (one row a plane),
``blocks`` (a packed row for each matrix row), ``tokens`` and ``config``.  Import makes the
catalog from headers and is one job from tensor files to blocks; analysis reads counts
only; export decodes and quantizes in one pass, and the plan knows each row's place in the shards.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import naming as N
from ..functions.dims import FORMATS
from ..operators import blocks_arrow as BA
from ..operators import catalog as K
from ..operators import gguf_arrow as GA
from ..operators import stats as T
from ..operators import tokens as V
from ..operators import trellis as R
from ..sources import safetensors

EXPORT_DEFAULTS = {"target_format": "gguf", "quantization": {"default_type": "q4_k_m", "scale_optimization": "trellis", "trellis_lambda": 0.3, "per_tensor": {}}, "shard_size": None, "special_token_keys": {}}


def load_config(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} is not one config")
    return json.loads(rows[0][0])


def import_template(spark: SparkSession, source: str) -> dict:
    """Every tensor, included, under an id that depends on its name."""
    names = safetensors.headers(spark, source).select("name", N.tensor_id(F.col("name")).alias("id")).dropDuplicates(["name"]).orderBy("name").collect()
    return {"source_format": "safetensors", "block_format": "B8x8", "tensor_map": [{"source": r.name, "target": r.id, "include": True} for r in names]}


def import_model(spark: SparkSession, source: str, config: dict, out: str) -> DataFrame:
    """Blocks and catalog of the included tensors; returns the catalog."""
    fmt = config.get("block_format", "B16x8")
    if fmt not in FORMATS:
        raise ValueError(f"unknown block format {fmt}")
    wanted = [(t["source"], t["target"]) for t in config["tensor_map"] if t.get("include", True)]
    f = FORMATS[fmt]
    if f.dual:
        raise ValueError("dual-row formats pair rows of one matrix; import single-row formats and re-encode")
    targets = spark.createDataFrame(wanted, "name string, base_uuid string")
    # Headers say all of the catalog.  Files may repeat a tensor: the last file in name order counts.
    heads = safetensors.headers(spark, source).join(F.broadcast(targets), "name")
    heads = heads.groupBy("name").agg(F.max_by(F.struct("path", "dtype", "shape", "base_uuid"), "path").alias("h")).select("name", "h.*")
    rank = F.size("shape")
    planes = F.when(rank > 2, F.aggregate(F.slice("shape", 1, F.greatest(rank - 2, F.lit(0))), F.lit(1).cast("long"), lambda a, n: a * n)).otherwise(F.lit(1).cast("long"))
    heads = heads.withColumn("planes", planes).withColumn("rows", F.when(rank == 0, 1).when(rank == 1, F.get("shape", F.lit(0))).otherwise(F.get("shape", rank - 2)).cast("long"))
    heads = heads.withColumn("cols", F.when(rank <= 1, 1).otherwise(F.get("shape", rank - 1)).cast("long"))
    catalog = heads.withColumn("plane", F.explode(F.when(F.col("planes") > 0, F.sequence(F.lit(0).cast("long"), F.col("planes") - 1)))).withColumn("uuid", N.plane_id(F.col("base_uuid"), F.col("plane"), F.col("planes")))
    catalog = catalog.withColumn("plane_name", N.plane_name(F.col("name"), F.col("plane"), F.col("planes"))).withColumn("block_format", F.lit(fmt))
    catalog.coalesce(1).write.mode("overwrite").parquet(f"{out}/catalog")
    stored = spark.read.parquet(f"{out}/catalog")
    places = stored.select("name", "path", "plane", "uuid")  # names and ids of one model
    rows = safetensors.packed(spark, source, [s for s, _ in wanted], fmt).join(F.broadcast(places), ["name", "path", "plane"])
    rows.select("uuid", "row", *BA.PACKED_NAMES).write.mode("overwrite").parquet(f"{out}/blocks")  # each task has runs of tensors' rows, in order
    _store_tokens(spark, source, out)
    return stored


TOKENS = "id long, token string, embedding_row long, special boolean, special_type string, score double, kind string"
CONFIG = "architecture string, " + ", ".join(f"{k} long" for k in K.FIELDS)


def _store_tokens(spark: SparkSession, source: str, out: str) -> None:
    """The tables ``tokens`` and ``config`` of a model folder; empty where it has no such files."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,tiktoken}").load(source).select("path").collect()
    names = {r.path.rsplit("/", 1)[-1] for r in listed}
    if "tokenizer.json" in names or any(n.endswith(".tiktoken") for n in names):
        tokens = V.read_tokenizer(spark, source)
        kind = F.lit("tiktoken")
        if "tokenizer.json" in names:
            kind = F.lit(spark.read.text(f"{source}/tokenizer.json", wholetext=True).select(F.get_json_object("value", "$.model.type")).first()[0])
        tokens = tokens.withColumn("kind", kind)
    else:
        tokens = spark.createDataFrame([], TOKENS)
    write_tokens(tokens, f"{out}/tokens")
    config = K.model_config(spark.read.text(f"{source}/config.json", wholetext=True)) if "config.json" in names else spark.createDataFrame([], CONFIG)
    config.coalesce(1).write.mode("overwrite").parquet(f"{out}/config")


def write_tokens(tokens: DataFrame, path: str) -> None:
    """A vocabulary with the ``kind`` of its tokenizer, in embedding order."""
    columns = [c.split()[0] for c in TOKENS.split(", ")]
    tokens.select(*columns).orderBy("embedding_row", "token").coalesce(1).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    found = spark.read.parquet(path)
    missing = [c.split()[0] for c in TOKENS.split(", ") if c.split()[0] not in found.columns]
    if missing:
        raise ValueError(f"{path} is no vocabulary: it lacks {', '.join(missing)}")
    return found


def model_metadata(spark: SparkSession, path: str, special_token_keys: dict | None = None) -> dict:
    """Keys and values of the container: the model's known fields, and its vocabulary."""
    config = spark.read.parquet(f"{path}/config")
    found = {"general.architecture": "llama"}
    found |= {r.key: int(r.value) if r.value.isdigit() else r.value for r in K.container_metadata(config).collect()}
    tokens = read_tokens(spark, f"{path}/tokens")
    if first := tokens.select("kind").first():
        found |= {r.key: json.loads(r.value) for r in V.container_entries(tokens, first[0], special_token_keys).collect()}
    return found


def open_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The catalog and the relation of all blocks, (row_group, uuid, block, scale_log, rows)."""
    catalog, packed, fmt = _opened(spark, path)
    return catalog, BA.relational(packed, fmt, ("uuid",))


def _opened(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    catalog = spark.read.parquet(f"{path}/catalog")
    return catalog, spark.read.parquet(f"{path}/blocks"), catalog.select("block_format").first()[0]


def stored_rows(blocks: DataFrame, fmt: str) -> DataFrame:
    """(uuid, row, values) of single-row blocks, decoded; one shuffle by row."""
    return BA.decode(blocks, fmt, ("uuid",))


def analyze(spark: SparkSession, path: str, high: float = 0.2, medium: float = 0.1) -> DataFrame:
    """(name, container_name, rows, cols, importance, quant_type): the first plane stands for a tensor."""
    catalog, packed, _ = _opened(spark, path)
    stats = packed.groupBy("uuid").agg(F.coalesce(F.sum("shifted") / F.nullif(F.sum("nnz"), F.lit(0)), F.lit(0.0)).alias("importance"))
    first = catalog.where("plane = 0")
    both = first.join(stats, "uuid")
    total = F.col("rows") * F.col("planes")
    return both.select("name", N.container_name(F.col("name")).alias("container_name"), total.alias("rows"), "cols", "importance", T.recommend(F.col("name"), total, F.col("cols"), F.col("importance"), high, medium).alias("quant_type"))


def export_template(spark: SparkSession, path: str, high: float = 0.2, medium: float = 0.1) -> dict:
    found = analyze(spark, path, high, medium).select("name", "container_name", "quant_type").orderBy("name").collect()
    config = json.loads(json.dumps(EXPORT_DEFAULTS))
    config["quantization"]["per_tensor"] = {r.name: r.quant_type for r in found}
    config["tensor_map"] = [{"source": r.name, "target": r.container_name} for r in found]
    return config


def scale_penalty(quantization: dict) -> float | None:
    """The trellis penalty that a config asks for; none for standard scales, which any other word means."""
    if quantization.get("scale_optimization", "trellis").lower() != "trellis":
        return None
    return float(quantization.get("trellis_lambda", R.LAMBDA))


def export_records(spark: SparkSession, path: str, config: dict) -> tuple[DataFrame, DataFrame]:
    """(plan, records): records(name in the container, row, data), the bytes of each row.

    Unknown types are reported in the plan's ``error``; their tensors have no records.
    """
    if config.get("target_format", "gguf") != "gguf":
        raise ValueError("only gguf can be written")
    quant = config["quantization"]
    catalog, packed, fmt = _opened(spark, path)
    named = spark.createDataFrame([(t["source"], t["target"]) for t in config["tensor_map"]] or [], "name string, target string")
    tensors = catalog.where("plane = 0").join(F.broadcast(named), "name").select("name", "target", "shape", "planes", "cols", (F.col("rows") * F.col("planes")).alias("total"))
    overrides = spark.createDataFrame(sorted(quant.get("per_tensor", {}).items()) or [], "name string, wanted string")
    plan = K.export_plan(tensors.select("name", "shape"), overrides, quant.get("default_type", "q4_k_m")).join(tensors, "name")
    plan = plan.withColumn("ordinal", F.row_number().over(_all().orderBy("name")).cast("long"))
    most = config.get("shard_size") or (1 << 62)
    sized = K.assign_shards(plan.where("bytes is not null").select("ordinal", "bytes"), most)
    plan = plan.join(sized.select("ordinal", "shard"), "ordinal", "left")

    # Both are of the catalog of one model: a row for each plane.
    known = catalog.select("uuid", "name", "plane", F.col("rows").alias("plane_rows")).join(plan.where("error is null").select("name", "container_type"), "name")
    rows = packed.join(F.broadcast(known), "uuid")
    rows = rows.withColumn("row", F.col("plane") * F.col("plane_rows") + F.col("row"))
    if plan.where("error is null").limit(1).count() == 0:
        raise ValueError("nothing to export")
    made = GA.packed_records(rows.withColumnRenamed("container_type", "type"), fmt, scale_penalty(quant))
    targets = plan.select(F.col("name").alias("source"), F.col("target").alias("name"))
    return plan, made.withColumnRenamed("name", "source").join(F.broadcast(targets), "source").select("name", "row", "data")


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # the catalog of one model: names only


def layout(plan: DataFrame) -> DataFrame:
    """plan's tensors as the container has them: (shard, ordinal, name, rows, cols, type, bytes)."""
    return plan.where("error is null").select("shard", "ordinal", F.col("target").alias("name"), F.col("total").alias("rows"), "cols", F.col("container_type").alias("type"), "bytes")


def export_model(spark: SparkSession, path: str, config: dict, folder: str, stem: str = "model", metadata: dict | None = None) -> DataFrame:
    """Container files of all shards in a shared folder; returns (shard, path, tensors, size)."""
    from ..sources.containers import write_shards

    plan, records = export_records(spark, path, config)
    values = model_metadata(spark, path, config.get("special_token_keys")) | (metadata or {})
    return write_shards(layout(plan), records, folder, stem, values)


def validate(spark: SparkSession, path: str, config: dict, folder: str) -> DataFrame:
    """(name, ok) of each planned tensor: whether the files in ``folder`` hold it with its shape, type and bytes."""
    from ..sources.containers import container_tensors

    plan, _ = export_records(spark, path, config)
    found = container_tensors(spark, folder).select("shard", "name", "rows", "cols", "type", "bytes", "inside")
    both = layout(plan).join(found, ["shard", "name", "rows", "cols", "type", "bytes"], "left")
    return both.select("name", F.coalesce("inside", F.lit(False)).alias("ok"))
