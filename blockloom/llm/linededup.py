r"""Line dedup by a log-template tree, in DataFrame functions only.

A line descends a tree of fixed depth: its number of tokens, its leading tokens,
then the rest.  Tokens with a digit are variable fields at every level.  Other
fields are learned: a line of ``GENERAL_FROM`` tokens or more is cut into
``PARTS`` runs of tokens and takes one path for each run left open, so lines of
equal length that differ in one run only, be it the leading one, meet in a leaf
and share a template whose differing tokens are wildcards; at least about
three quarters of the tokens agree.  Shorter lines have one path, all tokens.

A template recurs if it stands in at least ``MIN_DOCUMENTS`` documents of
different texts; copies of whole documents count once, however many they are, and
are left to near-dedup.  The smallest doc_id that holds a recurring template keeps
its lines; the lines of it are dropped from all other documents.

Texts are cut into lines once, and written as hashes.  Only hashes are shuffled to
find the templates, pre-aggregated by template and text, so that a line found in
every other document makes no large group; paths that no other text can share, and
texts that lose no line, are kept out of the shuffles by bit maps of fixed size.  The
recurring templates are written out, so the join back is one that Spark can split.

Defined results: a null text is one empty line; lines of fewer than
``MIN_TOKENS`` tokens stay; rows repeated with the same id and text are treated
alike; different texts under one smallest id all keep theirs; a document that
loses all lines stays, with an empty text; an empty table gives an empty result;
further columns, whatever their names, are kept by ``drop_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import free_names, materialize, sieve, sieved

MIN_TOKENS, GENERAL_FROM, PARTS = 4, 6, 4
MIN_DOCUMENTS = 3
BLANK = r"[\x20\x09-\x0D]+"
#: A token with a digit, entered only at its start.
VARIABLE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"


def _row_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_runs(docs: DataFrame, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """doc_id, row (a key of the text), pos, n and the hashes of the ``PARTS`` runs of tokens of each line of ``docs(doc_id, text)``."""
    text = F.coalesce("text", F.lit(""))
    masked = F.when(text.rlike("[0-9]"), F.regexp_replace(text, VARIABLE, "<*>")).otherwise(text)
    lines = docs.select("doc_id", _row_key(F.col("text")).alias("row"), F.posexplode(F.split(masked, "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", "row", "pos", F.array_remove(F.split("line", BLANK, -1), "").alias("tokens")).withColumn("n", F.size("tokens")).where(F.col("n") >= min_tokens)
    cut = [F.expr(f"cast(floor({k} * n / {PARTS}) as int)") for k in range(PARTS + 1)]
    return lines.select("doc_id", "row", "pos", "n", *[F.xxhash64(F.slice("tokens", cut[k] + 1, cut[k + 1] - cut[k])).alias(f"run{k}") for k in range(PARTS)])


RUNS = [f"run{k}" for k in range(PARTS)]


def _halves() -> list[Column]:
    """The keys of a line's two halves; a path with an open run in one of them keeps the other whole."""
    return [F.xxhash64("n", F.lit(-2 - h), *RUNS[h * PARTS // 2 : (h + 1) * PARTS // 2]) for h in range(2)]


def line_paths(lines: DataFrame) -> DataFrame:
    """doc_id, row, pos and template (a hash) for each path of ``line_runs`` that may lead to a recurring template.

    Lines that share a path share the half of their tokens that it keeps whole, so
    paths whose half is found in one text only are left out by a sieve.
    """
    halves = lines.select("row", F.explode(F.array(*_halves())).alias("half"))
    shared = halves.groupBy("half").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).where("lo <> hi")
    bits = sieve(shared, "half")
    marked = lines
    for h, key in enumerate(_halves()):
        marked = sieved(marked.withColumn(f"half{h}", key), bits, f"shared{h}", f"half{h}")
    whole = F.array(F.when(F.col("shared0") & F.col("shared1"), F.xxhash64("n", *RUNS)))
    open_one = F.array(*[F.when(F.col(f"shared{int(k < PARTS // 2)}"), F.xxhash64("n", F.lit(k), *[r for r in RUNS if r != f"run{k}"])) for k in range(PARTS)])
    marked = marked.where("shared0 or shared1")
    return marked.select("doc_id", "row", "pos", F.explode(F.when(F.col("n") < GENERAL_FROM, whole).otherwise(open_one)).alias("template")).where("template is not null")


def recurring_templates(paths: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """template, its number of different texts and the smallest doc_id that holds it."""
    by_text = paths.groupBy("template", "row").agg(F.min("doc_id").alias("first"))
    return by_text.groupBy("template").agg(F.count(F.lit(1)).alias("n_texts"), F.min("first").alias("first")).where(F.col("n_texts") >= min_documents)


def dropped_positions(docs: DataFrame, min_tokens: int = MIN_TOKENS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """doc_id, row and ``gone``: the positions of the lines to drop, ascending."""
    paths = materialize(line_paths(materialize(line_runs(docs.select("doc_id", "text"), min_tokens), "line-runs")), "line-paths")
    recurring = materialize(recurring_templates(paths, min_documents).select("template", "first"), "line-templates")
    later = paths.join(recurring, "template").where("doc_id <> first")
    return later.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def drop_lines(docs: DataFrame, min_tokens: int = MIN_TOKENS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """All columns of ``docs`` with the text that stays, and two more: the numbers of lines and of dropped ones."""
    row, gone, lines, n_lines, n_dropped, loses = free_names(docs, "row", "gone", "lines", "n_lines", "n_dropped", "loses")
    found = materialize(dropped_positions(docs, min_tokens, min_documents).withColumnsRenamed({"row": row, "gone": gone}), "line-gone")
    df = sieved(docs.withColumn(row, _row_key(F.col("text"))), sieve(found, "doc_id", row), loses, "doc_id", row)
    df = df.withColumn(n_lines, F.length(F.regexp_replace(F.coalesce("text", F.lit("")), "[^\n]+", "")).cast("long") + 1)
    out = [F.col(f"`{c}`") for c in docs.columns]
    whole = df.where(~F.col(loses)).select(*out, n_lines, F.lit(0).cast("long").alias(n_dropped))
    df = df.where(F.col(loses)).join(found, ["doc_id", row], "left").withColumn(lines, F.split(F.coalesce("text", F.lit("")), "\n", -1))
    # Lines between those that go, as runs: what stays is found without a search for each line.
    at = f"concat(array(-1), `{gone}`, array(size(`{lines}`)))"
    stays = F.expr(f"array_join(flatten(transform(sequence(0, size(`{gone}`)), k -> slice(`{lines}`, element_at({at}, k + 1) + 2, element_at({at}, k + 2) - element_at({at}, k + 1) - 1))), '\n')")
    df = df.withColumn(n_dropped, F.coalesce(F.size(gone), F.lit(0)).cast("long")).withColumn("text", F.when(F.col(gone).isNull(), F.col("text")).otherwise(stays))
    return whole.unionByName(df.select(*out, n_lines, n_dropped))


def report(docs: DataFrame) -> DataFrame:
    found = drop_lines(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit("")).alias("text"))
