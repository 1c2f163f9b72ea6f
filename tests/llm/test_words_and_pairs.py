"""PII, near-duplicates, decontamination, line templates and quality counts against brute force."""

import hashlib
import re
import string
from collections import Counter, defaultdict

import duckdb
import pytest

from blockloom.llm import decontam, linededup, neardup, pii, quality, toxicity

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
WORD = re.compile("[^\x20\x09-\x0d]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m, d: 14 <= len(d) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 10 <= len(d) <= 15),
}


def base_spans(text: str) -> list[tuple]:
    out = []
    for k, (kind, (pattern, good)) in enumerate(PLAIN.items()):
        out += [(m.start(), k, m.end(), kind) for m in re.finditer(pattern, text) if good(m.group(), re.sub("[^0-9]", "", m.group()))]
    return sorted(out)


def test_pii(spark, docs, nothing):
    cases = [
        "a@b.c_d@e.f x@y.zz", "1.2.3.4.5 001.2.3.256 256.1.1.1 1.2.3.0000255", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111",
        "+1 (632) 555-4827, (632) 555-4827 call 632-555-1234 +12", "a@@b.c foo@bar foo@bar.com. é@b.fr 😀 a@b.de", "@" * 500 + "a" * 3000 + "@b.c" + ".c" * 3000, "1.2.3.4" * 50, "card 4111111111111112 x",
    ]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(910000 + i, c) for i, c in enumerate(cases)], "doc_id long, text string"))
    got = defaultdict(list)
    for r in pii.report(df).collect():
        got[r.doc_id].append(r)
    texts = df.collect()
    assert sum(map(len, got.values())) == len(texts)
    for r in texts:
        spans = base_spans(r.text or "")
        text = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
        counts = Counter(s[3] for s in spans)
        for g in got[r.doc_id]:
            assert (g.n_email, g.n_ip, g.n_card, g.n_phone) == tuple(counts[k] for k in PLAIN), r
            assert g.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
            assert not spans or set(text.split(",")) <= set(g.spans.split(","))
    assert pii.report(nothing).count() == 0


def test_em_finds_reliable_labelers():
    prior, rates = pii.em({0b111: 40, 0b011: 10, 0b000: 45, 0b100: 5}, 3)
    assert 0.3 < prior < 0.7
    assert all(true > false for true, false in rates[:2])
    _, rates = pii.em({0b1111: 50, 0b0111: 40}, known={3: (0.999, 0.1)})
    assert rates[3] == (0.999, 0.1)


def test_the_classifier_decides(spark):
    """Planted data and decoys: precision and recall of what is accepted, and of what is added to the base."""
    import random

    r = random.Random(4)
    rows, want = [], {}

    def plant(text, value, kind, true, base):
        at = text.index(value)
        rows.append((len(rows), text))
        want[len(rows) - 1, kind, at, at + len(value)] = (true, base)

    def number(good, first):
        while True:
            digits = first + "".join(r.choice("0123456789") for _ in range(16 - len(first)))
            if luhn(digits) == good:
                return digits

    for k in range(60):
        plant(f"please pay by card {(v := number(True, '4'))} today", v, "card", True, True)
        plant(f"the sum of it is {(v := number(False, r.choice('018')))} in all", v, "card", False, False)
        plant(f"send mail to {(v := f'ann{k}@host{k}.com')} now", v, "email", True, True)
        plant(f"call me at {(v := f'+1 ({r.randint(200, 900)}) 555-{k + 1000}')} soon", v, "phone", True, True)
    for k in range(20):
        plant(f"write to me: {(v := f'bob{k} [at] place{k} [dot] org')} thanks", v, "email", True, False)
        plant(f"look {(v := f'9{k} (at) 7 (dot) {k}')} for it", v, "email", False, False)
    found = {(r.doc_id, pii.KINDS[x.kind], x.start, x.end): (x.accepted, x.base) for r in pii.judged(spark.createDataFrame(rows, "doc_id long, text string")).collect() for x in r.found}
    assert all(found[key][1] == base for key, (_, base) in want.items())
    right = sum(found[key][0] == true for key, (true, _) in want.items())
    assert right >= 0.95 * len(want), [(key, rows[key[0]][1]) for key, (true, _) in want.items() if found[key][0] != true][:5]
    spans = {r.doc_id: r.spans for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all((f"{kind}:{a}:{b}" in spans[d].split(",")) == (base or found[d, kind, a, b][0]) for (d, kind, a, b), (_, base) in want.items())


def test_decoys_of_the_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    seen = [(x.kind, x.base, x.accepted) for r in pii.judged(df).collect() for x in r.found]
    assert {a for _, _, a in seen} == {True, False}
    assert not any(a for k, b, a in seen if pii.KINDS[k] == "card" and not b)  # numbers that fail the check digit


def shingles(text: str) -> frozenset:
    words = WORD.findall(text.translate(LOWER))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(rows) -> dict:
    sets = [(r.doc_id, shingles(r.text or "")) for r in rows]
    parent = {d: d for d, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= 85 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in parent}


def test_near_duplicates(spark, docs, nothing):
    base = [f"w{k}" for k in range(200)]
    edited = []
    for k in range(12):  # copies that are near to the original, not all to each other
        words = list(base)
        words[15 * k] = f"z{k}"
        edited.append((920000 + k, " ".join(words)))
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([*edited, (920100, " ".join(base))], "doc_id long, text string"))
    want = brute_components(df.collect())
    rows = neardup.near_duplicates(df).collect()
    assert len(rows) == df.count()
    sets = defaultdict(set)
    for r in df.collect():
        sets[r.doc_id].add(len(shingles(r.text or "")))
    for r in rows:
        assert r.component_id == want[r.doc_id]
        assert r.n_shingles in sets[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)
    assert neardup.near_duplicates(nothing).count() == 0
    kept = neardup.first_of_each(docs)
    assert kept.columns == docs.columns


def test_signatures_are_close_to_jaccard():
    import numpy as np

    a = neardup.mix(np.arange(2000, dtype=np.uint64))
    s = neardup.signatures([np.sort(a[:1500]), np.sort(a[500:])], 400)
    assert abs((s[0] == s[1]).mean() - 0.5) < 0.1


ITEM_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


@pytest.mark.parametrize("block_words", [2_000_000, 500])
def test_decontamination(spark, docs, nothing, small, block_words):
    bench = small("benchmark").unionByName(spark.createDataFrame([(7001, "the and"), (7002, ""), (7003, None), (7001, "the and")], "item_id long, text string"))
    first = bench.orderBy("item_id").first().text
    df = docs.unionByName(docs.limit(1).selectExpr("930000L as doc_id", f"'so {first.upper()} it is' as text", *docs.columns[2:]))
    windows = defaultdict(set)
    for r in bench.collect():
        w = ITEM_WORD.findall((r.text or "").translate(LOWER))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(str(r.item_id))
    want = Counter()
    for r in df.collect():
        w, hit, items = ITEM_WORD.findall((r.text or "").translate(LOWER)), set(), set()
        for n in {len(p) for p in windows}:
            for k in range(len(w) - n + 1):
                if owners := windows.get(tuple(w[k : k + n])):
                    items |= owners
                    hit.update(range(k, k + n))
        want[r.doc_id, len(w), len(hit), tuple(sorted(items))] += 1
    got = Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontam.scan(df, bench, block_words=block_words).collect())
    assert got == want
    assert decontam.clean_documents(df, bench).columns == df.columns
    assert decontam.report(nothing, bench).count() == 0
    assert decontam.report(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_line_templates(spark, docs, nothing):
    from blockloom.llm.queries import ORACLES

    passage = " ".join(f"word{k}" for k in range(60))
    made = [(940000 + k, f"own line {'abcd'[k]} of this one here\n{passage}\nits end {'abcd'[k]} is here") for k in range(4)]
    df = docs.select("doc_id", "text").where("doc_id <> 900008").unionByName(spark.createDataFrame(made, "doc_id long, text string"))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in linededup.report(df).collect()}
    assert [passage in got[940000 + k][2] for k in range(4)] == [True, False, False, False]
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert got == {r[0]: r[1:] for r in con.execute(f"select doc_id, n_lines, n_dropped, text from ({ORACLES['op6_line_templates']})").fetchall()}
    copies = spark.createDataFrame([(k, "one line of five words\nanother line of five words") for k in range(50)], "doc_id long, text string")
    assert linededup.report(copies).where("n_dropped > 0").count() == 0
    assert linededup.report(nothing).count() == 0
    assert linededup.drop_lines(docs).columns == [*docs.columns, "n_lines", "n_dropped"]


def test_templates_of_the_tree(spark):
    """Each line's template as text, by hand: what the hashes of the tree stand for."""
    names = "anna bert carl dora emil fred gina hans".split()
    own = ["alder birch cedar", "daisy elder fern", "grass heath iris", "juniper kelp lotus"]
    notice = ["this notice comes first in all of them", "then follows what nobody ever reads", "rights are given to whom it may concern", "and so ends what the lawyers wrote"]
    rows = [(k, f"user {n} logged in from the office today") for k, n in enumerate(names)]
    rows += [(100 + k, "\n".join([f"{own[k % 4]} {'x' * k}", *notice, f"{'y' * k} {own[k // 4 % 4]} {'z' * k}"])) for k in range(1, 16)]
    rows += [(200 + k, f"disk {k} of host h{k} is full") for k in range(5)]  # fields with digits
    rows += [(300, "red green blue cyan pink gold"), (301, "red green blue cyan pink gray"), (302, "red green lime cyan pink gold")]  # three paths, none with three texts
    got = {r.doc_id: r for r in linededup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k].n_dropped for k in range(8)] == [0] + [1] * 7
    assert [got[k].n_dropped for k in range(101, 116)] == [0] + [4] * 14  # the inner lines too
    assert all(got[100 + k].text == "\n".join(rows[7 + k][1].split("\n")[:: 5]) for k in range(2, 16))
    assert [got[k].n_dropped for k in range(200, 205)] == [0, 1, 1, 1, 1]
    assert [got[k].n_dropped for k in range(300, 303)] == [0, 0, 0]


def test_names_that_clash(spark, small):
    from pyspark.sql import functions as F

    text = "a line that many texts hold here"
    rows = [(k, f"{text}\nown {w} words of it") for k, w in enumerate(("one", "two", "three"))]
    names = ["_row", "_gone", "gone", "row", "ROW_", "lines", "n_lines", "n_dropped", "_n_words", "n_words", "n_hit", "items", "matches", "score", "_text", "_words", "words", "lines_", "kept", "base_failed", "word_chars"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(f"own {n}") for n in names})
    bench, labels = small("benchmark"), small("labels")
    for kept in (linededup.drop_lines(df), decontam.clean_documents(df, bench), toxicity.acceptable(df, labels), neardup.first_of_each(df), quality.judge(df)):
        assert kept.columns[: len(df.columns)] == df.columns
        for r in kept.collect():
            assert tuple(r)[2 : len(df.columns)] == tuple(f"own {n}" for n in names)


def test_quality(docs, nothing):
    got = defaultdict(set)
    for r in quality.report(docs).collect():
        got[r.doc_id].add(tuple(r)[1:7])
    for r in docs.collect():
        text = r.text or ""
        words = WORD.findall(text)
        grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen, covered, lines, dup = Counter(grams), set(), set(), 0
        for i, g in enumerate(grams):
            if seen[g] > 1:
                covered.update((i, i + 1, i + 2))
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in lines
                lines.add(line)
        n = len(words)
        want = (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), n < 50 or 100 * len(covered) > 50 * n)
        assert want in got[r.doc_id]
    assert quality.report(nothing).count() == 0


def test_cascade_order(docs):
    from pyspark.sql import functions as F

    rules = [quality.Rule("keeps all", F.lit(True)), quality.Rule("drops most", F.col("n_words") > 10_000), quality.Rule("drops most at a price", F.length(F.regexp_replace("text", "[a-z]+", "")) + F.col("n_words") > 10**9)]
    ordered = quality.estimate(quality.with_counts(quality.prepared(docs)), rules)
    assert [r.name for r in ordered] == ["drops most", "drops most at a price", "keeps all"]
    assert ordered[1].cost > ordered[0].cost
