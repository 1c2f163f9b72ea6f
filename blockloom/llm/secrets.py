"""Secret scans: candidates by shape, false positives removed by a random forest.

Candidates are all long runs of key characters, words and numbers among them, and
values assigned to names such as ``password``.  The forest judges each by its
length, the transitions between kinds of characters, how much of it is made of
dictionary words and of common letter pairs, whether it is part of a path or
address, and the words beside it.  It is trained on
labelled findings: by default a generated set of ``FINDINGS`` examples of keys,
tokens and passwords (true) and of paths, identifiers, checksums, placeholders
and long words (false); a table of own findings can be passed instead.

Defined results: null and empty texts have no candidates; repeated rows are
reported each; texts are scanned whole; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship

FINDINGS, TREES, DEPTH = 4_000, 32, 8
ACCEPT = 0.5

RUN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])"
NAMED = r"(?i:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|auth)\b[\"']?[ ]?[=:]{1,2}[ ]?[\"']?([^\s\"'<>]{6,})"
CANDIDATE = re.compile(f"{NAMED}|({RUN})")
#: Words beside a finding.
FOR = re.compile(r"(?i)pass|pwd|secret|token|key|auth|credential|bearer|login")
AGAINST = re.compile(r"(?i)sha|md5|commit|checksum|hash|uuid|example|sample|version|path|file|revision|digest|build")
#: Common English letter pairs; words are made of them, keys aren't.
PAIRS = frozenset("th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ro ri io ne me co la li el ma ec ic us ca ch ll be di wo ho pe om em tr wa so ta no no ge ns ss ly mo fo po ai ee rs".split())
#: Words that names, paths and placeholders are made of.
DICTIONARY = frozenset(
    "about account address admin application archive article backup base build cache change channel check class client code color column command comment common config connect content control copy count create current data database date debug default demo description detail device dir display document domain download element email empty end engine entry error event example export fail false feature field file filter final find first folder font format from function global handler head header help hidden home host icon image import index info item java key label language last level library license line link list load local log login main map master member message method mode model module name network new next node none number object option order output package page panel param parent password path pattern policy port process product profile project public query read record release report request reset resource response result root save script search secret server service session set setting site source status storage store system template test text theme time title token total update upload user util version web with word xml year your".split()
)
KNOWN = re.compile("|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=lambda w: (-len(w), w))))


def features(value: str, before: str, after: str) -> list[float]:
    n = len(value)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in value]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    counts: dict[str, int] = {}
    for c in value:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    low = value.lower()
    pairs = [low[i : i + 2] for i in range(n - 1) if low[i : i + 2].isalpha()]
    covered = sum(p in PAIRS for p in pairs) / max(1, n - 1)
    known = sum(len(m[0]) for m in KNOWN.finditer(low)) / n
    hexed = sum(c in "0123456789abcdefABCDEF" for c in value) / n
    path = value.count("/") + value.count(".") + ("/" in before[-2:]) + ("://" in before[-12:]) + ("." in after[:1] and after[1:2].isalpha())
    runs = max((len(r) for r in re.findall(r"[a-z]+|[A-Z]+", value)), default=0)
    return [
        n, changes / n, entropy, covered, kinds.count("d") / n, kinds.count("u") / n, kinds.count("s") / n, hexed, path, runs / n,
        float(bool(FOR.search(before))), float(bool(AGAINST.search(before) or AGAINST.search(value))), float(before.rstrip("\"' ").endswith(("=", ":"))), len(counts) / n, known,
    ]


def labelled_findings(count: int = FINDINGS, seed: int = 11) -> list[tuple[str, str, str, int]]:
    """(value, text before, text after, label), half of each label."""
    r = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = lambda: "".join(r.choice(sorted(PAIRS)) for _ in range(r.randint(1, 5)))
    of = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    names = sorted(DICTIONARY)
    out = []
    for k in range(count):
        left, right = " ".join(word() for _ in range(4)) + " ", " " + " ".join(word() for _ in range(3))
        if k % 2:
            kind = r.randrange(5)
            if kind == 0:
                value = "AKIA" + of("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16)
            elif kind == 1:
                value, left = of("0123456789abcdef", r.choice((32, 40, 64))), left + r.choice(('token = "', 'secret: "', "api_key="))
            elif kind == 2:
                value, left = of(r.choice(("0123456789abcdef", alnum, alnum + "!@#$%")), r.randint(8, 24)), left + r.choice(("password=", "pwd: ", 'passwd = "'))
            elif kind == 3:
                value = r.choice(("ghp_", "sk_live_", "xoxb-", "")) + of(alnum, r.randint(24, 44))
            else:
                value = of(alnum + "+/", 40)
        else:
            kind = r.randrange(8)
            part = lambda: r.choice(names) if r.random() < 0.5 else word()
            if kind == 0:
                value = "/".join(part() for _ in range(r.randint(3, 7)))
            elif kind == 1:
                value = r.choice(("_", "-")).join(part() for _ in range(r.randint(3, 6)))
            elif kind == 2:
                value, left = of("0123456789abcdef", r.choice((32, 40, 64))), left + r.choice(("commit ", "sha256:", "md5 ", "checksum ", "revision "))
            elif kind == 3:
                value, left = r.choice(("changeme", "xxxxxxxxxx", "your_password", "example", "placeholder", "<secret>", "********")), left + r.choice(("password=", "token: ", "secret = "))
            elif kind == 4:
                value = "-".join(of("0123456789abcdef", n) for n in (8, 4, 4, 4, 12))
            elif kind == 5:
                value = "".join(word() for _ in range(r.randint(5, 9)))
                value = r.choice((value, value.capitalize(), value.upper()))
            elif kind == 6:
                value = "".join(w.capitalize() for w in (part() for _ in range(r.randint(3, 6)))) + r.choice(("", "", "2", "V3"))
            else:
                value, left = of("0123456789", r.randint(16, 22)), left + r.choice(("", "order ", "id "))
        out.append((value, left[-32:], right[:16], k % 2))
    return out


# ---- the forest -----------------------------------------------------------------


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int):
    """A tree as nested tuples (feature, threshold, low, high); a leaf is its share of true findings."""
    share = float(y.mean())
    if depth == 0 or len(y) < 8 or share in (0.0, 1.0):
        return share
    best = (1e-6, None, None)
    base = share * (1 - share)
    for f in rng.choice(x.shape[1], max(2, int(math.sqrt(x.shape[1]))), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        n = cut + 1.0
        p, q = t[cut] / n, (t[-1] - t[cut]) / (len(y) - n)
        gain = base - (n * p * (1 - p) + (len(y) - n) * q * (1 - q)) / len(y)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
    if best[1] is None:
        return share
    low = x[:, best[1]] <= best[2]
    return (best[1], best[2], grow(x[low], y[low], rng, depth - 1), grow(x[~low], y[~low], rng, depth - 1))


def train(findings: list[tuple[str, str, str, int]], trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> list:
    x = np.array([features(v, b, a) for v, b, a, _ in findings])
    y = np.array([label for *_, label in findings], float)
    rng = np.random.default_rng(seed)
    forest = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        forest.append(grow(x[rows], y[rows], rng, depth))
    return forest


def predict(forest: list, row: list[float]) -> float:
    total = 0.0
    for node in forest:
        while isinstance(node, tuple):
            node = node[2] if row[node[0]] <= node[1] else node[3]
        total += node
    return total / len(forest)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every candidate value."""
    for m in CANDIDATE.finditer(text):
        yield m.span(1 if m[1] is not None else 2)


def scan(docs: DataFrame, findings: list[tuple[str, str, str, int]] | None = None, accept: float = ACCEPT) -> DataFrame:
    """doc_id, n_candidates and ``secrets``: start, end (code points, end exclusive) and score of what the forest accepts."""
    spark = docs.sparkSession
    ship(spark)
    forest = spark.sparkContext.broadcast(train(labelled_findings() if findings is None else findings))  # TREES * 2**DEPTH nodes
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = forest.value
        for batch in batches:
            n, found = [], []
            for value in batch.column(1):
                text, seen, kept = value.as_py() or "", 0, []
                for a, b in candidates(text):
                    seen += 1
                    score = predict(trees, features(text[a:b], text[max(0, a - 32) : a], text[b : b + 16]))
                    if score >= accept:
                        kept.append({"start": a, "end": b, "score": round(score, 6)})
                n.append(seen)
                found.append(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, spans)], names=["doc_id", "n_candidates", "secrets"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_candidates long, secrets array<struct<start: int, end: int, score: double>>")


def report(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    spans = F.array_join(F.transform("secrets", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), spans.alias("spans"))
