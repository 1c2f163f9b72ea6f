"""Queries over the test tables, one for each text operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import report

    return report(table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .htmltext import extract

    return extract(table(spark, sf_dir, "pages"))


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import report

    return report(table(spark, sf_dir, "documents"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import report

    return report(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import report

    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import report

    return report(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import report

    return report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_pii": op1_pii,
    "op2_minhash": op2_minhash,
    "op3_decontamination": op3_decontamination,
    "op4_packing": op4_packing,
    "op5_html": op5_html,
    "op6_line_templates": op6_line_templates,
    "op7_secrets": op7_secrets,
    "op8_toxicity": op8_toxicity,
    "op9_sharding": op9_sharding,
    "op10_quality": op10_quality,
}

ORACLES: dict[str, str] = {
    "op6_line_templates": r"""
with cut as (
    select distinct doc_id, coalesce(text, '') as text, string_split(coalesce(text, ''), chr(10)) as parts from documents),
lines as (
    select doc_id, text, unnest(parts) as line, generate_subscripts(parts, 1) as pos from cut),
masked as (
    select *, list_filter(regexp_split_to_array(regexp_replace(line, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+'), lambda t: t <> '') as tokens from lines),
paths as (
    select doc_id, text, pos, tokens, len(tokens) as n, unnest(case when len(tokens) < 6 then [-1] else [0, 1, 2, 3] end) as k from masked where len(tokens) >= 4),
named as (
    select doc_id, text, pos, case when k < 0 then array_to_string(tokens, ' ')
        else concat(n, '|', k, '|', array_to_string(tokens[1:(k * n) // 4], ' '), '|', array_to_string(tokens[((k + 1) * n) // 4 + 1:n], ' ')) end as template from paths),
recurring as (
    select template, min(doc_id) as first from named group by template having count(distinct text) >= 3),
gone as (
    select distinct doc_id, text, pos from named join recurring using (template) where doc_id <> first),
lost as (
    select l.doc_id, l.text, l.pos, l.line, g.pos is not null as gone from lines l left join gone g on l.doc_id = g.doc_id and l.text = g.text and l.pos = g.pos),
kept as (
    select doc_id, text as whole, count(*) as n_lines, count(*) filter (where gone) as n_dropped, coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '') as text
    from lost group by doc_id, text)
select d.doc_id, n_lines, n_dropped, kept.text from documents d join kept on d.doc_id = kept.doc_id and coalesce(d.text, '') = kept.whole""",
    "op10_quality": r"""
with d as (
    select doc_id, coalesce(text, '') as t from documents),
w as (
    select doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
g as (
    select doc_id, i, count(*) over (partition by doc_id, words[i], words[i + 1], words[i + 2]) as n
    from (select doc_id, words, unnest(range(1, len(words) - 1)) as i from w)),
r as (
    select doc_id, count(distinct p) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as p from g where n > 1) group by doc_id),
c as (
    select w.doc_id, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
        cast(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
        cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, len(lines) as n_lines,
        length(regexp_replace(t, '[^\p{L}]+', '', 'g')) as letters, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) as capitals
    from w left join r on w.doc_id = r.doc_id),
b as (
    select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and 20 * n_symbols <= word_chars and 2 * n_dup_lines <= n_lines and word_chars between 2 * n_words and 20 * n_words
        and 2 * letters >= word_chars and 2 * capitals <= word_chars as kept
from b""",
}
