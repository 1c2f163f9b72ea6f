"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is an expression that says whether a text passes.  On a sample of about
``sample_rows`` rows of all partitions the cascade measures what evaluating a rule
costs and how many texts it rejects, and orders the rules by rejections per cost; a
text that one rule rejects is not shown to the later ones (CASE stops at the first
match), so their own work on the text (letters, capitals) is done for few.  The
base counts are results and are made for every text.  The order decides the time,
never the verdict: a text is kept if all rules pass.

Defined results: a null text has no words and fails the base rules, as does an
empty one; repeated rows are judged alike; an empty table gives an empty
result; further columns, whatever their names, are kept by ``judge``.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import free_names

BLANK = r"[\x20\x09-\x0D]+"
SAMPLE_ROWS = 500  #: rows, about, on which costs and rejections are estimated


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def prepared(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """One column ``d``, the row of ``docs``, and what the rules read: ``text``, ``words``, ``lines``."""
    df = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("d"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    df = df.withColumn("words", F.array_remove(F.split("text", BLANK, -1), ""))
    return df.withColumn("lines", F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))


def with_counts(df: DataFrame) -> DataFrame:
    """Adds the ``COUNTS`` of the whole text to a ``prepared`` table."""
    df = df.withColumn("n_words", F.size("words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    df = df.withColumn("n_symbols", F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    # Windows of three words by their hash; most texts hold none twice, which a set of hashes tells without a sort.
    hashes = F.expr("transform(sequence(0, cast(n_words as int) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))")
    df = df.withColumn("hashes", F.when(F.col("n_words") >= 3, hashes))
    none = "cast(array() as array<struct<h: bigint, i: int>>)"
    windows = f"case when size(array_distinct(hashes)) < size(hashes) then array_sort(transform(hashes, (h, i) -> named_struct('h', h, 'i', i))) else {none} end"
    df = df.withColumn("sorted", F.expr(windows))
    same = "sorted[{0}].h = sorted[{1}].h and words[sorted[{0}].i] = words[sorted[{1}].i] and words[sorted[{0}].i + 1] = words[sorted[{1}].i + 1] and words[sorted[{0}].i + 2] = words[sorted[{1}].i + 2]"
    twice = F.expr(f"""
        array_sort(transform(filter(case when size(sorted) > 1 then sequence(0, size(sorted) - 1) else cast(array() as array<int>) end,
            k -> (k > 0 and {same.format("k", "k - 1")}) or (k < size(sorted) - 1 and {same.format("k", "k + 1")})), k -> sorted[k].i))""")
    df = df.withColumn("twice", twice)
    covered = F.expr("""
        case when size(twice) = 0 then 0L
        else aggregate(case when size(twice) > 1 then sequence(1, size(twice) - 1) else cast(array() as array<int>) end,
            3L, (total, k) -> total + least(3, twice[k] - twice[k - 1])) end""")
    return df.withColumn("n_repeat_words", covered).drop("hashes", "sorted", "twice")


@dataclass
class Rule:
    name: str
    passes: Column
    cost: float = 0.0
    rejects: float = 0.0

    @property
    def worth(self) -> float:
        return self.rejects / max(self.cost, 1e-12)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules beyond the base ones.  They read ``text``, ``words``, ``lines`` and the counts."""
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace("text", r"[^\p{Lu}]+", ""))
    return [
        Rule("few symbols", 20 * F.col("n_symbols") <= F.col("word_chars")),
        Rule("few repeated lines", 2 * F.col("n_dup_lines") <= F.size("lines")),
        Rule("word length", F.col("word_chars").between(2 * F.col("n_words"), 20 * F.col("n_words"))),
        Rule("mostly letters", 2 * letters >= F.col("word_chars")),
        Rule("few capitals", 2 * capitals <= F.col("word_chars")),
    ]


REPEATS = 24  #: times a rule is evaluated on the sample in one job, so that its work stands out from the job's own
TRIALS = 3


def estimate(sample: DataFrame, rules: list[Rule]) -> list[Rule]:
    """Rules with their cost in seconds a text and their share of rejections, best first; ties keep their order.

    A rule is priced by a job that evaluates it ``REPEATS`` times a row, less one that
    evaluates nothing, the least of ``TRIALS`` each.
    """
    sample = sample.persist()
    try:
        row = sample.select(F.count(F.lit(1)).alias("n"), *[F.avg((~F.coalesce(r.passes, F.lit(False))).cast("double")).alias(f"r{k}") for k, r in enumerate(rules)]).first()
        times = sample.select("*", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))).alias("time"))

        def seconds(passes: Column) -> float:
            least = math.inf
            for _ in range(TRIALS):
                began = time.perf_counter()
                times.agg(F.count_if(passes)).collect()
                least = min(least, time.perf_counter() - began)
            return least

        empty = seconds(F.col("time") > 0)
        for k, rule in enumerate(rules):
            rule.cost, rule.rejects = max(0.0, seconds(rule.passes) - empty) / max(1, REPEATS * row["n"]), row[f"r{k}"] or 0.0
    finally:
        sample.unpersist()
    return sorted(rules, key=lambda r: -r.worth)


def cascade(rules: list[Rule]) -> Column:
    """True if all rules pass; the first that doesn't ends the evaluation."""
    verdict = None
    for rule in rules:
        fails = ~F.coalesce(rule.passes, F.lit(False))
        verdict = F.when(fails, False) if verdict is None else verdict.when(fails, False)
    return verdict.otherwise(True) if verdict is not None else F.lit(True)


def judge(docs: DataFrame, rules: list[Rule] | None = None, sample_rows: int = SAMPLE_ROWS, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, then the ``COUNTS``, ``base_failed`` and ``kept``, lengthened where ``docs`` has such names."""
    rules = default_rules() if rules is None else rules
    share = min(1.0, sample_rows / max(docs.count(), 1))
    sample = docs.sample(fraction=share, seed=5)  # about sample_rows, from all partitions alike
    ordered = estimate(with_counts(prepared(sample, text_col)), rules)
    df = with_counts(prepared(docs, text_col)).withColumn("base_failed", base_failed())
    df = df.withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(ordered)))
    added = (*COUNTS, "base_failed", "kept")
    own = [F.col(f"d.c{k}").alias(c) for k, c in enumerate(docs.columns)]
    return df.select(*own, *[F.col(c).alias(n) for c, n in zip(added, free_names(docs, *added), strict=True)])


def report(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).drop("text")
