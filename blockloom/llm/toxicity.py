"""Toxicity scores from a weighted finite-state pattern grammar.

Small transducers rewrite the word classes of a clause: one recognises insults
and threats, one joins them with the person they aim at, one marks negated
matches, and one those inside reported speech.  They are composed into one
machine, which is run over each clause that holds an insult or a threat; the
document's score is a logistic function of the composed matches it emits, not
of isolated words.

The insult vocabulary (words and stems) and the weights are learned from
labelled rows: at most ``max_rows`` of those whose crc32(doc_id as text) mod 3
is not 1, taken by the hash of their ids.  Everything else covers all rows and
whole texts.

Defined results: null and empty texts score as texts without matches; labels of
unknown ids and null labels are not used; repeated rows score alike; with no
labelled rows the vocabulary is empty and the prior weights hold; further
columns are ignored by ``report`` and kept by ``acceptable``.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import free_names, materialize, ship

#: Closed word classes of the grammar.
THREATS = ("kill", "hurt", "destroy", "beat", "strangle", "burn")
TARGETS = ("you", "your", "u", "ur", "he", "she", "they", "them", "him", "her", "ihr", "du", "dich", "tu", "toi", "vous", "usted", "ustedes")
NEGATIONS = ("not", "never", "no", "isn't", "aren't", "nicht", "nie", "pas", "jamais", "nunca")
REPORTS = ("said", "says", "called", "calls", "wrote", "quoted", "sagte", "dit", "dijo")

MAX_ROWS = 8_000  #: labelled rows that vocabulary and weights are fitted on, at most
MIN_DOCS, MIN_SHARE, PURITY = 5, 0.01, 0.02  #: toxic documents of an entry; clean ones per toxic one
PREDICT_FROM = 0.7

FEATURES = ("insult", "aimed insult", "negated", "reported", "threat", "aimed threat")
PRIOR = np.array([3.0, 3.5, 1.0, 1.5, 1.5, 3.0])
PRIOR_BIAS = -3.5


# ---- transducers ----------------------------------------------------------------


class Transducer:
    """Deterministic: rules {(state, symbol): (next state, output)}; a symbol without a rule passes and resets."""

    def __init__(self, rules: dict, start: int = 0):
        self.rules, self.start = rules, start

    def step(self, state, symbol: str):
        return self.rules.get((state, symbol), (self.start, symbol))

    def run(self, symbols: list[str]) -> list[str]:
        state, out = self.start, []
        for s in symbols:
            state, o = self.step(state, s)
            out.append(o)
        return out


class Composed(Transducer):
    """The second transducer reads what the first writes; steps are made when first met, then kept."""

    def __init__(self, a: Transducer, b: Transducer):
        super().__init__({}, (a.start, b.start))
        self.a, self.b = a, b

    def step(self, state, symbol: str):
        if (state, symbol) not in self.rules:
            p, middle = self.a.step(state[0], symbol)
            q, out = self.b.step(state[1], middle)
            self.rules[state, symbol] = ((p, q), out)
        return self.rules[state, symbol]


def within(opener: str, changes: dict[str, str], reach: int, alphabet: str) -> Transducer:
    """For ``reach`` symbols after ``opener``, rewrites the symbols in ``changes``."""
    rules = {}
    for state in range(reach + 1):
        for s in alphabet:
            if s == opener:
                rules[state, s] = (reach, s)
            else:
                rules[state, s] = (max(0, state - 1), changes.get(s, s) if state else s)
    return Transducer(rules)


#: Word classes: insult I, threat V, target Y, negation N, report R, others O.  Emitted: aimed A and B,
#: negated n, reported r.
ALPHABET = "IVYNROABn"


def grammar() -> Transducer:
    aim = within("Y", {"I": "A", "V": "B"}, 4, ALPHABET)
    negate = within("N", {"I": "n", "V": "n", "A": "n", "B": "n"}, 3, ALPHABET)
    report = within("R", {"I": "r", "V": "r", "A": "r", "B": "r"}, 6, ALPHABET)
    return Composed(Composed(aim, negate), report)


EMITS = {"I": 0, "A": 1, "n": 2, "r": 3, "V": 4, "B": 5}
CLAUSE = re.compile(r"[.!?;:\n]+")
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
FIXED = {w: c for words, c in ((THREATS, "V"), (TARGETS, "Y"), (NEGATIONS, "N"), (REPORTS, "R")) for w in words}


class Scorer:
    """Counts the composed matches of texts.  Entries: words ending in $, and stems."""

    def __init__(self, entries: list[str]):
        import ahocorasick

        self.words = {e[:-1] for e in entries if e.endswith("$")}
        self.stems = tuple(sorted(e for e in entries if not e.endswith("$")))
        self.lengths = sorted({len(s) for s in self.stems})
        self.stem_set = set(self.stems)
        self.machine = grammar()
        self.finder = ahocorasick.Automaton()
        for w in self.words | self.stem_set | set(THREATS):
            self.finder.add_word(w, len(w))
        if len(self.finder):
            self.finder.make_automaton()

    def class_of(self, word: str) -> str:
        if word in self.words or any(word[:k] in self.stem_set for k in self.lengths):
            return "I"
        return FIXED.get(word, "O")

    def __call__(self, text: str | None) -> list[int]:
        counts = [0] * len(FEATURES)
        if not text or not len(self.finder):
            return counts
        text = text.lower()
        done = 0
        for end, length in self.finder.iter(text):
            begin = end - length + 1
            if begin < done or begin and text[begin - 1].isalpha():
                continue
            a = begin
            while a > done and text[a - 1] not in ".!?;:\n":
                a -= 1
            stop = CLAUSE.search(text, end)
            done = stop.end() if stop else len(text)
            for symbol in self.machine.run([self.class_of(w) for w in TOKEN.findall(text[a : stop.start() if stop else done])]):
                if symbol in EMITS:
                    counts[EMITS[symbol]] += 1
        return counts


def pieces(text: str) -> set[str]:
    """Whole words, and stems of four to seven letters."""
    out = set()
    for w in set(TOKEN.findall(text.lower())):
        out.add(w + "$")
        out.update(w[:k] for k in range(4, min(8, len(w))))
    return out


# ---- learning --------------------------------------------------------------------


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, toxic) of the labelled rows to learn from; equal texts once, toxic if any of them is."""
    usable = labels.where("toxic is not null and doc_id is not null").where("pmod(crc32(cast(cast(doc_id as string) as binary)), 3) <> 1")
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")  # max_rows ids at most
    return materialize(rows.groupBy("text").agg(F.max("toxic").alias("toxic")), "toxicity-training")


def _count_pieces(known: set[str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = pieces(text)
                for p in found if known is None else found & known:
                    total[p] = total.get(p, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["piece", "n"])

    return run


def learn_entries(rows: DataFrame) -> list[str]:
    sizes = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    least = max(MIN_DOCS, math.ceil(MIN_SHARE * toxic))

    def counted(part: DataFrame, known: set[str] | None) -> DataFrame:
        return part.select("text").mapInArrow(_count_pieces(known), "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))

    bad = {r.piece: r.n for r in counted(rows.where("toxic = 1"), None).where(F.col("n") >= least).collect()}
    good = {r.piece: r.n for r in counted(rows.where("toxic = 0"), set(bad)).collect()} if bad else {}
    pure = {p: n for p, n in bad.items() if good.get(p, 0) / max(clean, 1) <= PURITY * n / toxic and good.get(p, 0) <= PURITY * n}
    entries = []
    for p, n in pure.items():
        bare = p.rstrip("$")
        shorter = [bare[:k] for k in range(4, len(bare) + (p != bare))]
        if any(n < 0.95 * pure.get(s, 0) for s in shorter):  # a part of what a shorter stem covers
            continue
        entries.append(p)
    # Of nested entries that cover the same documents the longest says what the word is.
    return sorted(e for e in entries if not any(o != e and o.startswith(e) and pure[o] >= 0.95 * pure[e] for o in entries))


def fit(features: np.ndarray, toxic: np.ndarray, strength: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton steps, drawn to the prior weights."""
    x = np.column_stack((np.log1p(features), np.ones(len(features))))
    prior = np.append(PRIOR, PRIOR_BIAS)
    w = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - toxic) + strength * (w - prior)
        curve = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def _matches(entries: list[str], text_at: int, name: str = "_matches"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(entries)
        for batch in batches:
            counts = [scorer(t.as_py()) for t in batch.column(text_at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.list_(pa.int32()))], names=[*batch.schema.names, name])

    return run


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[str], list[float], float]:
    """Vocabulary, weights and bias."""
    ship(docs.sparkSession)
    rows = training_rows(docs, labels, max_rows)
    entries = learn_entries(rows)
    seen = rows.mapInArrow(_matches(entries, 0), "text string, toxic int, _matches array<int>").groupBy("_matches", "toxic").count().collect()
    if not seen:
        return entries, PRIOR.tolist(), PRIOR_BIAS
    x = np.repeat(np.array([r[0] for r in seen], float), [r[2] for r in seen], axis=0)
    y = np.repeat(np.array([r[1] for r in seen], float), [r[2] for r in seen])
    weights, bias = fit(x, y)
    return entries, weights.tolist(), bias


def score(docs: DataFrame, model: tuple[list[str], list[float], float]) -> DataFrame:
    """All columns of ``docs`` and, last, a score from 0 to 1, named ``score`` or longer if that is taken."""
    from pyspark.sql import types as T

    entries, weights, bias = model
    ship(docs.sparkSession)
    matches, name = free_names(docs, "matches", "score")
    kind = T.StructType([*docs.schema.fields, T.StructField(matches, T.ArrayType(T.IntegerType()))])
    marked = docs.mapInArrow(_matches(entries, docs.columns.index("text"), matches), kind)
    total = F.lit(bias)
    for k, w in enumerate(weights):
        total = total + F.log1p(F.col(matches)[k]) * w
    return marked.withColumn(name, 1 / (1 + F.exp(-total))).drop(matches)


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs.select("doc_id", "text"), train(docs, labels))
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= PREDICT_FROM).cast("int").alias("predicted"))


def acceptable(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that aren't predicted toxic, with their own columns."""
    scored = score(docs, train(docs, labels))
    return scored.where(F.col(scored.columns[-1]) < PREDICT_FROM).select(*[f"`{c}`" for c in docs.columns])
