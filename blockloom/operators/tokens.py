"""Vocabulary tables: tokenizer files to (id, token, embedding_row, special, special_type, score)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.naming import lookup

#: Container keys of special tokens, and container names of tokenizer kinds.
SPECIAL_KEYS = {
    "bos": "tokenizer.ggml.bos_token_id", "eos": "tokenizer.ggml.eos_token_id", "unk": "tokenizer.ggml.unknown_token_id", "pad": "tokenizer.ggml.padding_token_id",
    "sep": "tokenizer.ggml.seperator_token_id", "cls": "tokenizer.ggml.cls_token_id", "mask": "tokenizer.ggml.mask_token_id", "eot": "tokenizer.ggml.eot_token_id",
}
MODELS = {"BPE": "gpt2", "WordLevel": "gpt2", "tiktoken": "gpt2", "Unigram": "llama", "WordPiece": "bert"}


def vocabulary(files: DataFrame) -> DataFrame:
    """(kind, token, id, score) from the JSON of tokenizer files in column ``value``.

    The vocabulary is an object of ids or an array of pairs, whose places are the ids.
    """
    kind = F.get_json_object("value", "$.model.type")
    vocab = F.get_json_object("value", "$.model.vocab")
    df = files.select(kind.alias("kind"), vocab.alias("vocab")).where(F.col("kind").isin(*MODELS))
    table = df.where(~F.startswith("vocab", F.lit("["))).select("kind", F.explode(F.from_json("vocab", "map<string,bigint>")).alias("token", "id")).withColumn("score", F.lit(None).cast("double"))
    pairs = df.where(F.startswith("vocab", F.lit("["))).select("kind", F.posexplode(F.from_json("vocab", "array<array<string>>")).alias("id", "pair"))
    return table.unionByName(pairs.select("kind", F.col("pair")[0].alias("token"), F.col("id").cast("long").alias("id"), F.col("pair")[1].try_cast("double").alias("score")))


def special_tokens(configs: DataFrame) -> DataFrame:
    """(special_type, token): keys ending in ``_token`` whose value is a string or has a string content."""
    entries = configs.select(F.explode(F.from_json("value", "map<string,string>")).alias("special_type", "v")).where(F.endswith("special_type", F.lit("_token")))
    token = F.when(F.startswith("v", F.lit("{")), F.get_json_object("v", "$.content")).otherwise(F.col("v"))
    return entries.select("special_type", token.alias("token")).where("token is not null")


def rank_lines(lines: DataFrame) -> DataFrame:
    """(token, id) of lines of base64 and rank; lines of another form are skipped."""
    parts = F.split("value", " ")
    cut = lines.where(F.size(parts) == 2).select(parts[0].alias("b"), parts[1].try_cast("long").alias("id"))
    good = cut.where(F.col("id").isNotNull() & F.col("b").rlike("^[A-Za-z0-9+/]+={0,2}$") & (F.length("b") % 4 == 0))
    return good.select(F.expr("decode(unbase64(b), 'UTF-8')").alias("token"), "id")


def with_specials(vocab: DataFrame, specials: DataFrame) -> DataFrame:
    """The token table, special tokens marked by their first type in name order."""
    by_token = specials.groupBy("token").agg(F.min("special_type").alias("special_type"))
    both = vocab.join(by_token, "token", "left")
    return both.select("id", "token", F.col("id").alias("embedding_row"), F.col("special_type").isNotNull().alias("special"), F.coalesce("special_type", F.lit("")).alias("special_type"), F.coalesce("score", F.lit(0.0)).alias("score"))


def token_type(special: Column, special_type: Column, token: Column) -> Column:
    """1 normal, 2 unknown, 3 control, 6 byte."""
    return F.when(special & F.contains(special_type, F.lit("unk")), 2).when(special, 3).when(F.startswith(token, F.lit("<0x")) & F.endswith(token, F.lit(">")), 6).otherwise(1)


def special_ids(tokens: DataFrame, keys: dict[str, str] | None = None) -> DataFrame:
    """(key, id) of the special tokens that have a key; an empty key suppresses one."""
    table = SPECIAL_KEYS | (keys or {})
    bare = F.regexp_replace("special_type", "(_token)+$", "")
    return tokens.where("special and special_type <> ''").select(lookup(table, bare).alias("key"), F.col("embedding_row").alias("id")).where("key <> ''")


def container_entries(tokens: DataFrame, kind: str, keys: dict[str, str] | None = None) -> DataFrame:
    """(key, value as JSON) of a tokenizer in the container; the arrays are in embedding order.

    A vocabulary is small (some 100,000 tokens) and one value in the container, hence one row.
    """
    ordered = F.sort_array(F.collect_list(F.struct("embedding_row", "token", "score", token_type(F.col("special"), F.col("special_type"), F.col("token")).alias("type"))))
    one = tokens.agg(ordered.alias("t"))
    entries = F.map_from_arrays(
        F.array(*[F.lit(f"tokenizer.ggml.{n}") for n in ("model", "tokens", "scores", "token_type")]),
        F.array(F.lit(f'"{MODELS[kind]}"'), *[F.to_json(F.col(f"t.{n}")) for n in ("token", "score", "type")]),
    )
    arrays = one.select(F.explode(entries).alias("key", "value"))
    return arrays.unionByName(special_ids(tokens, keys).select("key", F.col("id").cast("string").alias("value")))


def read_tokenizer(spark: SparkSession, folder: str) -> DataFrame:
    """Token table of a model folder: tokenizer.json, or else the first ranks file."""
    names = sorted(r.path.rsplit("/", 1)[-1] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.{json,tiktoken}").load(folder).select("path").collect())
    text = lambda name: spark.read.text(f"{folder}/{name}", wholetext=True)
    specials = special_tokens(text("tokenizer_config.json")) if "tokenizer_config.json" in names else spark.createDataFrame([], "special_type string, token string")
    if "tokenizer.json" in names:
        vocab = vocabulary(text("tokenizer.json")).select("token", "id", "score")
    else:
        ranks = [n for n in names if n.endswith(".tiktoken")]
        if not ranks:
            raise FileNotFoundError(f"no tokenizer in {folder}")
        vocab = rank_lines(spark.read.text(f"{folder}/{ranks[0]}")).withColumn("score", F.lit(None).cast("double"))
    return with_specials(vocab, specials)
