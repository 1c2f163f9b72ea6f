"""Personal data by weak supervision, in DataFrame functions only.

Candidates are the base spans and looser ones (digit groups that fail the card
check, phone numbers without a country code, spelled-out addresses).  Four
labelers vote on each: a shape (regex), a gazetteer (domain endings, issuers'
ranges, calling and area codes, public networks), the words before it (context) and
a check of its parts (check digit, calling code, octets).  The numbers of vote
patterns, counted over all rows, are all that the driver sees (2,048 rows at most).
Expectation-maximisation on them estimates how reliable each labeler is, but for the
check digit, whose rates are known: issued numbers pass it, one in ten others does.
A log-linear span classifier is trained on the posteriors; it sees the votes and
features that no labeler has (glued to a word, usual length, words that speak
against it, regular groups).  It judges all candidates; looser ones that it accepts
are added to the base spans, which stay whatever it says.

Java's regular expressions meet words of any length here, so the patterns below
are written without backtracking: they find what the plain ones find.

Defined results: a null text is an empty one; repeated rows are reported each;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import materialize

KINDS = ("email", "ip", "card", "phone")

#: A run of name characters is entered at its start or where the last match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Looser shapes.
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[(]at[\])] ?[A-Za-z0-9-]++(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]++)++"
NATIONAL = r"(?<![0-9+(.-])(?:\([0-9]{3}\) ?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9.-])"

#: Cue words by kind, looked for in the 48 characters before a candidate, and words that speak against it.
CUES = {
    "email": "mail|contact|write|reach|send",
    "ip": "address|host|server|login|from ip|node",
    "card": "card|visa|credit|debit|pay",
    "phone": "phone|call|tel|mobile|fax|number",
}
AGAINST = "version|release|order|invoice|isbn|serial|article|part no|ticket|ref|meet|look"
WINDOW = 48
#: Endings of mail domains and international calling codes.
ENDINGS = "com org net edu gov mil int info biz io dev app ai co me tv us uk de fr es it nl be at ch se no dk fi pl cz pt gr ie ru ua tr in cn jp kr au nz ca mx br ar cl za"
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 216 218 220 221 233 234 254 255 351 352 353 354 355 356 357 358 359 370 371 372 380 381 385 386 387 420 421 852 886 961 962 965 966 971 972 974"
#: Patterns of the gazetteers: endings, networks that are not public, issuers' ranges with their lengths, calling and area codes.
GAZETTEER = {
    "email": rf"(?i)[.\s\])]({ENDINGS.replace(' ', '|')})$",
    "ip": r"^(?!0|10\.|127\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.168\.|2[2-5][0-9]\.)",
    "card": r"^(4([\x20-]?[0-9]){15}|5[\x20-]?[1-5]([\x20-]?[0-9]){14}|2[\x20-]?[2-7]([\x20-]?[0-9]){14}|3[\x20-]?[47]([\x20-]?[0-9]){13}|6[\x20-]?[05]([\x20-]?[0-9]){14}|3[\x20-]?[0689]([\x20-]?[0-9]){12})$",
    "phone": rf"^(\+({CALLING.replace(' ', '|')})[^0-9]|\(?[2-9](?!11)[0-9]{{2}}[^0-9])",
}
SHAPE = {
    "email": r"^[A-Za-z][A-Za-z0-9._%+-]*( ?[\[(]at[\])] ?|@)[A-Za-z]",
    "ip": r"^[1-9][0-9]{0,2}(\.(0|[1-9][0-9]{0,2})){3}$",
    "card": r"^([0-9]{14,19}|([0-9]{4}[ -]){3}[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})$",
    "phone": r"^(\+[0-9]{1,3} ?[( -]|\(?[0-9]{3}\)?[ .-]{1,2}[0-9]{3}[.-])",
}
_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"
CHECK = {
    "email": r"x.m rlike r'[.\s\])][A-Za-z]{2,24}$'",
    "ip": r"x.m rlike r'^(?!0)(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$'",
    "card": f"luhn_check({_DIGITS})",
    "phone": rf"{_DIGITS} rlike if(x.m like '+%', r'^({CALLING.replace(' ', '|')})[1-9][0-9]{{6,}}$', r'^[2-9][0-9]{{2}}[2-9][0-9]{{6}}$')",
}
USUAL = {"email": "length(x.m) between 6 and 64", "ip": "length(x.m) between 7 and 15", "card": f"length({_DIGITS}) in (14, 15, 16, 19)", "phone": f"length({_DIGITS}) between 10 and 13"}
REGULAR = {"email": r"x.m rlike r'^[^@]*@?[^@.]*([.][^.]*){1,3}$'", "ip": r"x.m rlike r'^[0-9]{1,3}([.][0-9]{1,3}){3}$'", "card": rf"x.m rlike r'{SHAPE['card']}'", "phone": r"x.m rlike r'^[^0-9]?([0-9]+[^0-9]+){1,5}[0-9]+$'"}
#: A check digit is passed by all issued numbers and by one other number in ten.
KNOWN = {"card": {3: (0.999, 0.1)}}
LABELERS, SIGNS = 4, 8  #: votes are the low bits of a pattern, further features the next ones


def _spans(pattern: str, guard: Column) -> Column:
    """array<struct<start, end, m>>: code points, end exclusive, of all matches; ``guard`` false: none."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    return F.when(guard, found)


def _placed(df: DataFrame, name: str, pattern: str, guard: Column) -> DataFrame:
    """Adds column ``name``: matches with their places, from the lengths of what lies between them."""
    df = df.withColumn("_m", _spans(pattern, guard))
    df = df.withColumn("_s", F.when(F.size("_m") > 0, F.split("text", pattern, -1)))
    place = """
        case when _s is null then cast(array() as array<struct<start: int, end: int, m: string>>)
        else aggregate(sequence(0, size(_m) - 1), named_struct('at', 0, 'out', cast(array() as array<struct<start: int, end: int, m: string>>)),
            (acc, k) -> named_struct(
                'at', acc.at + length(_s[k]) + length(_m[k]),
                'out', array_append(acc.out, named_struct('start', acc.at + length(_s[k]), 'end', acc.at + length(_s[k]) + length(_m[k]), 'm', _m[k]))),
            acc -> acc.out) end"""
    return df.withColumn(name, F.expr(place)).drop("_m", "_s")


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id and ``found``: candidates with kind, start, end, base and their signs (votes and further features)."""
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    digits = F.col("text").rlike("[0-9]")
    df = _placed(df, "_email", EMAIL, F.contains("text", F.lit("@")))
    df = _placed(df, "_spelled", SPELLED, F.contains("text", F.lit("at)")) | F.contains("text", F.lit("at]")))
    df = _placed(df, "_ip", IP, digits)
    df = _placed(df, "_card", CARD, digits)
    df = _placed(df, "_phone", PHONE, F.contains("text", F.lit("+")))
    df = _placed(df, "_national", NATIONAL, digits)
    plain = _DIGITS

    def of(column: str, kind: str, base: str, keep: str = "true") -> str:
        # Numbers are compared as text: a part of any length is at most 255 if what follows its zeros is.
        signs = [
            f"x.m rlike r'{SHAPE[kind]}'", f"x.m rlike r'{GAZETTEER[kind]}'", f"x.before rlike '{CUES[kind]}'", CHECK[kind],
            "not x.before rlike '[a-z0-9]$' and not x.after rlike '^[A-Za-z0-9]'", USUAL[kind], f"not x.before rlike '{AGAINST}'", REGULAR[kind],
        ]
        pattern = " + ".join(f"if({v}, {1 << k}, 0)" for k, v in enumerate(signs))
        near = f"lower(substring(text, greatest(1, x.start + 1 - {WINDOW}), least(x.start, {WINDOW})))"
        seen = f"transform(filter({column}, x -> {keep}), x -> named_struct('start', x.start, 'end', x.end, 'm', x.m, 'before', {near}, 'after', substring(text, x.end + 1, 1)))"
        return f"transform({seen}, x -> named_struct('kind', {KINDS.index(kind)}, 'start', x.start, 'end', x.end, 'base', {base}, 'signs', {pattern}))"

    parts = [
        of("_email", "email", "true"),
        of("_spelled", "email", "false"),
        of("_ip", "ip", "true", r"forall(split(x.m, '[.]'), p -> length(regexp_replace(p, '^0+', '')) < 3 or (length(regexp_replace(p, '^0+', '')) = 3 and regexp_replace(p, '^0+', '') <= '255'))"),
        of("_card", "card", f"luhn_check({plain})", f"length({plain}) between 14 and 19"),
        of("_phone", "phone", "true", f"length({plain}) between 10 and 15"),
        of("_national", "phone", "false"),
    ]
    return df.select("doc_id", F.expr(f"concat({', '.join(parts)})").alias("found"))


# ---- the label model: on counts of vote patterns, a table of fixed size ---------------


def em(counts: dict[int, float], labelers: int = LABELERS, rounds: int = 200, known: dict[int, tuple[float, float]] | None = None) -> tuple[float, list[tuple[float, float]]]:
    """Prior of personal data and, for each labeler, its rate of votes for true and for false spans; ``known`` rates stay."""
    known = known or {}
    total = sum(counts.values())
    prior, rates = 0.5, [known.get(k, (0.8, 0.3)) for k in range(labelers)]
    if not total:
        return prior, rates
    for _ in range(rounds):
        true = {v: posterior(v, prior, rates) * n for v, n in counts.items()}
        weight = sum(true.values())
        # One pseudo-count on each side keeps rates inside (0, 1) for rare patterns.
        after = [
            known.get(k) or ((sum(t for v, t in true.items() if v >> k & 1) + 0.8) / (weight + 1), (sum(counts[v] - true[v] for v in counts if v >> k & 1) + 0.3) / (total - weight + 1))
            for k in range(labelers)
        ]
        new_prior = (weight + 1) / (total + 2)
        moved = abs(new_prior - prior) + sum(abs(a - c) + abs(b - d) for (a, b), (c, d) in zip(after, rates, strict=True))
        prior, rates = new_prior, after
        if moved < 1e-9:
            break
    return prior, rates


def posterior(votes: int, prior: float, rates: list[tuple[float, float]]) -> float:
    yes, no = prior, 1 - prior
    for k, (a, b) in enumerate(rates):
        yes, no = (yes * a, no * b) if votes >> k & 1 else (yes * (1 - a), no * (1 - b))
    return yes / (yes + no) if yes + no else 0.0


def train_classifier(counts: dict[tuple[int, int], int], steps: int = 400) -> list[list[float]]:
    """For each kind: bias and weights of its signs, from counts of (kind, signs)."""
    models = []
    for kind, name in enumerate(KINDS):
        own = {s: n for (k, s), n in counts.items() if k == kind}
        votes: dict[int, float] = {}
        for s, n in own.items():
            low = s & (1 << LABELERS) - 1
            votes[low] = votes.get(low, 0) + n
        prior, rates = em(votes, known=KNOWN.get(name))
        total = sum(own.values()) or 1
        w = [0.0] * (SIGNS + 1)
        for _ in range(steps):
            slope = [0.0] * len(w)
            for s, n in own.items():
                x = [1.0, *(s >> k & 1 for k in range(SIGNS))]
                p = 1 / (1 + math.exp(-sum(a * c for a, c in zip(w, x, strict=True))))
                miss = n / total * (p - posterior(s & (1 << LABELERS) - 1, prior, rates))
                for i, v in enumerate(x):
                    slope[i] += miss * v
            w = [a - 1.0 * (g + 0.0005 * a) for a, g in zip(w, slope, strict=True)]
        models.append(w)
    return models


def accepted_signs(models: list[list[float]], accept: float = 0.5) -> list[tuple[int, int]]:
    """(kind, signs) that the classifiers accept."""
    least = math.log(accept / (1 - accept))
    return [(k, s) for k, w in enumerate(models) for s in range(1 << SIGNS) if w[0] + sum(w[1 + i] for i in range(SIGNS) if s >> i & 1) >= least]


def judged(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    """doc_id and ``found``: candidates with kind, start, end, base and whether the classifier accepts them."""
    found = materialize(candidates(docs), "pii-candidates")
    seen = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.signs").count().collect()  # 4 * 256 rows at most
    taken = accepted_signs(train_classifier({(r[0], r[1]): r[2] for r in seen}), accept)
    codes = ", ".join(str((k << SIGNS) + s) for k, s in taken) or "-1"
    return found.withColumn("found", F.expr(f"transform(found, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'base', x.base, 'accepted', shiftleft(x.kind, {SIGNS}) + x.signs in ({codes})))"))


def report(docs: DataFrame, accept: float = 0.5) -> DataFrame:
    found = judged(docs, accept)
    added = "x.base or (x.accepted and not exists(found, y -> y.base and y.kind = x.kind and y.start < x.end and x.start < y.end))"

    def joined(keep: str) -> Column:
        ordered = f"array_sort(transform(filter(found, x -> {keep}), x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end)))"
        names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
        return F.expr(f"array_join(transform({ordered}, x -> concat({names}[x.kind], ':', x.start, ':', x.end)), ',')")

    counts = [F.expr(f"size(filter(found, x -> x.base and x.kind = {k}))").cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    accepted = F.expr("size(filter(found, x -> x.accepted))").cast("long").alias("n_accepted")
    return found.select("doc_id", *counts, F.sha2(joined("x.base"), 256).alias("base_sha256"), joined(added).alias("spans"), F.size("found").cast("long").alias("n_candidates"), accepted)
