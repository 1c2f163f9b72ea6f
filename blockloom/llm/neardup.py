"""Near-duplicate documents by circulant MinHash.

Signature: one permutation maps the hashed shingles of a document to places, a
second one ranks them; its circular shift by k gives coordinate k as the least
rank, so two permutations serve all coordinates.  Coordinates are banded;
documents that share a band are candidates, and links are confirmed on the full
shingle sets.

The chance that a pair of similarity 0.85 shares none of 20 bands of 4
coordinates is (1 - 0.85**4) ** 20, below one in a million.

Documents with equal sets are one class from the start.  Within a bucket each
class is first compared with a central member (the one with most neighbours in
all its buckets), which joins a group of copies with one row for each member;
what stays apart from it elects another leader, as long as that joins many.

Classes of a bucket that are still in different components are then joined
exactly, without writing out their pairs: each is replaced by its symmetric
difference to a common reference, as |x ^ y| = |(x ^ r) ^ (y ^ r)|.  A link needs
a certain number of common elements of these small sets, so it has one among the
first elements of both (prefix and position filters), and only pairs that meet
there are confirmed on the full sets.

Defined results: null, empty and word-less texts have an empty set, no links,
and are kept; fewer words than a shingle are one shingle; repeated rows of a
doc_id are reported each, with the same component; further columns are ignored
by ``near_duplicates`` and kept by ``first_of_each``; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._components import components
from ._shared import chunks, materialize, ship, text_buffers
from ._words import SHINGLE, WordCodes, mix, windows

WORDS, BANDS, ROWS = 5, 20, 4
LEAST, OUT_OF = 85, 100  #: 100 * intersection >= 85 * union
LEADERS_JOIN = 8  #: another round of leaders if the last one joined one in so many; decides the time, not the result


def shingle_sets(raw: np.ndarray, at: np.ndarray, codes_of: WordCodes) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    codes, starts = codes_of(raw[at[0] : at[-1]], at - at[0])
    hashed = windows(codes, WORDS)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        if b - a >= WORDS:
            yield np.unique(hashed[a : b - WORDS + 1])
        elif b > a:
            yield mix(windows(codes[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray], count: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``count`` coordinates for each set; all sets must hold something."""
    at = np.append(0, np.cumsum([len(s) for s in sets]))[:-1]
    places = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)  # the first permutation
    out = np.empty((len(sets), count), np.uint32)
    rank, spare = np.empty_like(places), np.empty_like(places)
    for k in range(count):  # the second, shifted by k: place p has the rank of p + k
        np.add(places, np.uint32(k), out=rank)
        for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
            np.right_shift(rank, np.uint32(shift), out=spare)
            np.bitwise_xor(rank, spare, out=rank)
            np.multiply(rank, np.uint32(factor), out=rank)
        np.right_shift(rank, np.uint32(16), out=spare)
        np.bitwise_xor(rank, spare, out=rank)
        np.minimum.reduceat(rank, at, out=out[:, k])
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    keys = np.empty((len(signature), BANDS), np.uint64)
    for band in range(BANDS):
        total = np.full(len(signature), band + 1, np.uint64)
        for row in range(ROWS):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + signature[:, band * ROWS + row])
        keys[:, band] = total
    return keys.view(np.int64)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, size of the set, 128-bit digest of the set, band keys."""
    import xxhash

    codes_of = WordCodes(SHINGLE)
    for batch in batches:
        raw, at = text_buffers(batch.column(1))
        for lo, hi in chunks(at, 1 << 18):
            sets = list(shingle_sets(raw, at[lo : hi + 1], codes_of))
            some = [k for k, s in enumerate(sets) if len(s)]
            keys: list = [[]] * len(sets)
            if some:
                for k, row in zip(some, band_keys(signatures([sets[k] for k in some])), strict=True):
                    keys[k] = row
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in sets], pa.int64()), pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets], pa.string()), pa.array(keys, pa.list_(pa.int64()))],
                names=["doc_id", "n_shingles", "digest", "keys"],
            )


def _sets(sieve):
    """Sets and their digests of the documents that pass the sieve (a bit map over hashed ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        codes_of, bits = WordCodes(SHINGLE), sieve.value
        for batch in batches:
            places = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[places >> 6] >> (places & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            raw, at = text_buffers(batch.column(1))
            for lo, hi in chunks(at, 1 << 18):
                sets = [s.tobytes() for s in shingle_sets(raw, at[lo : hi + 1], codes_of)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([xxhash.xxh3_128_hexdigest(s) for s in sets], pa.string()), pa.array(sets, pa.binary())], names=["doc_id", "digest", "shingles"])

    return run


SIEVE_BITS = 1 << 26  #: 8 MB, however many documents there are; what passes by chance goes in the join


def _sieve(ids: DataFrame, column: str) -> np.ndarray:
    """Bit map of the hashed ids: it keeps the texts of most other documents out of a shuffle."""
    place = F.pmod(F.xxhash64(column), F.lit(SIEVE_BITS))
    words = ids.select(F.shiftright(place, 6).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64({column}), {SIEVE_BITS}L), 64) as int))").alias("bit"))
    rows = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # SIEVE_BITS / 64 rows at most
    out = np.zeros(SIEVE_BITS >> 6, np.uint64)
    out[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return out


def _shared_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b and the number of shingles that both sets hold."""
    for batch in batches:
        n = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            x, y = (x, y) if len(x) <= len(y) else (y, x)
            where = np.searchsorted(y, x)
            where[where == len(y)] = 0
            n.append(int((y[where] == x).sum()) if len(y) else 0)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), batch.column(4), batch.column(5)], names=["a", "b", "both", "n_a", "n_b"])


def _sets_of(reps: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, shingles and n_shingles of the classes ``reps(rep)``, from the whole texts."""
    wanted = materialize(reps.join(classes.select("rep", "digest", "n_shingles"), "rep"), "neardup-wanted")
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(wanted, "rep"))
    hashed = docs.withColumn("place", F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE_BITS)))
    passed = hashed.mapInArrow(_sets(sieve), "doc_id long, digest string, shingles binary")
    # Rows repeated with the same id and text give the same pairs again, which changes nothing.
    return materialize(passed.join(wanted.withColumnRenamed("rep", "doc_id"), ["doc_id", "digest"]), "neardup-sets")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) and whether they are linked, from the full sets."""
    left = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"), F.col("n_shingles").alias("n_a")), "a")
    both = left.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"), F.col("n_shingles").alias("n_b")), "b")
    both = both.select("a", "b", "x", "y", "n_a", "n_b").mapInArrow(_shared_count, "a long, b long, both long, n_a long, n_b long")
    return both.withColumn("linked", F.expr(f"{OUT_OF} * both >= {LEAST} * (n_a + n_b - both)"))


HEAD = 64  #: elements of a difference that go with each of its rows, to count common ones where two meet


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first elements of each class's difference to its reference, of which every link of it holds one.

    Sets x and y are linked if |x ^ y| <= reach * (|x| + |y|).  The order is: elements
    that the reference lacks (negative), then those that only it has, each by hash.
    Classes that are linked to the reference need no links to each other, so of any
    pair one is further from it than that; both bounds below follow from it.
    """
    reach = (OUT_OF - LEAST) / (OUT_OF + LEAST)
    for batch in batches:
        if not batch.num_rows:
            continue
        rows, tokens, places, sizes, near, heads = [], [], [], [], [], []
        for k, (x, r) in enumerate(zip(batch.column(4), batch.column(5), strict=True)):
            x, r = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(r.as_buffer(), np.uint64)
            own = np.setdiff1d(x, r, assume_unique=True) >> np.uint64(1)
            lost = np.setdiff1d(r, x, assume_unique=True) >> np.uint64(1)
            ordered = np.concatenate((own.view(np.int64) + np.iinfo(np.int64).min, lost.view(np.int64)))
            n = len(ordered)
            linked = (OUT_OF + LEAST) * n <= (OUT_OF - LEAST) * (len(x) + len(r))
            common = n - reach * len(x) * (1 + OUT_OF / LEAST)  # with the farthest size that can be linked
            if linked:  # then the other one isn't
                common = max(common, (n + reach * (len(r) - len(x))) / 2)
            first = max(0, n - max(1, int(np.ceil(common - 1e-6))) + 1)
            rows.append(np.full(first, k))
            tokens.append(ordered[:first])
            places.append(np.arange(first))
            sizes.append(np.full(first, n))
            near.append(np.full(first, linked))
            heads.append(ordered[:HEAD])
        at = pa.array(np.concatenate(rows))
        taken = [batch.column(c).take(at) for c in range(4)]
        yield pa.RecordBatch.from_arrays(
            [*taken, pa.array(np.concatenate(tokens)), pa.array(np.concatenate(places), pa.int32()), pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(near), pa.bool_()), pa.array(heads, pa.list_(pa.int64())).take(at)],
            names=["ref", "rep", "n", "component", "token", "place", "apart", "near", "head"],
        )


def _close_pairs(grouped: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that may be linked, for classes ``grouped(ref, rep, n, component)`` by reference."""
    both = grouped.join(sets.select(F.col("doc_id").alias("rep"), F.col("shingles").alias("x")), "rep")
    both = both.join(sets.select(F.col("doc_id").alias("ref"), F.col("shingles").alias("r")), "ref")
    firsts = both.select("ref", "rep", "n", "component", "x", "r").mapInArrow(_differences, "ref long, rep long, n long, component long, token long, place int, apart long, near boolean, head array<long>")
    firsts = materialize(firsts, "neardup-firsts")

    def side(name: str) -> DataFrame:
        return firsts.select("ref", "token", *[F.col(c).alias(f"{c}_{name}") for c in ("rep", "n", "component", "place", "apart", "near", "head")])

    # 2 * common >= apart_a + apart_b - reach * (n_a + n_b), in whole numbers.
    least = f"{OUT_OF + LEAST} * (apart_a + apart_b) - {OUT_OF - LEAST} * (n_a + n_b)"
    most = f"2 * {OUT_OF + LEAST} * least(apart_a - place_a, apart_b - place_b)"
    met = side("a").join(side("b"), ["ref", "token"]).where("rep_a < rep_b and component_a <> component_b and not (near_a and near_b)").where(f"{most} >= {least}")
    # Up to where the shorter head ends all common elements are in both heads; beyond, the shorter rest bounds them.
    end = "least(element_at(head_a, -1), element_at(head_b, -1))"
    rest = ", ".join(f"apart_{x} - size(filter(head_{x}, t -> t <= {end}))" for x in "ab")
    enough = f"2 * {OUT_OF + LEAST} * (size(c) + least({rest})) >= {least}"
    once = f"(greatest(place_a, place_b) >= {HEAD} or token = array_min(c))"  # where they first meet
    met = met.where(f"exists(array(array_intersect(head_a, head_b)), c -> {once} and {enough})")
    return met.select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    profile = materialize(docs.mapInArrow(_profile, "doc_id long, n_shingles long, digest string, keys array<long>"), "neardup-profile")
    # A doc_id that has several rows stands for one node: rows with different texts link through it.
    filled = profile.where("n_shingles > 0")
    classes = materialize(filled.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("keys").alias("keys")), "neardup-classes")

    entries = classes.select("rep", "n_shingles", F.explode("keys").alias("key"))
    sized = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    entries = materialize(entries.join(sized, "key"), "neardup-entries")
    central = entries.groupBy("rep").agg(F.sum("n").alias("weight"))
    entries = materialize(entries.drop("n").join(central, "rep"), "neardup-weighed")

    sets = _sets_of(entries.select("rep").distinct(), classes, docs)  # of all that share a bucket, once

    def by_weight(column: str) -> Column:
        return F.max_by(column, F.struct("weight", -F.col("rep")))

    found = spark.createDataFrame([], "node long, component long")
    links = spark.createDataFrame([], "a long, b long")
    apart, first_leaders = entries, None
    while True:  # each round sends one row for each class and bucket that no leader has joined
        leaders = apart.groupBy("key").agg(by_weight("rep").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "leader")
        led = materialize(apart.join(leaders, "key"), "neardup-led")
        first_leaders = led.select("key", "leader").distinct() if first_leaders is None else first_leaders
        pairs = led.where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
        measured = materialize(_confirmed(pairs, sets), "neardup-measured")
        compared, joined = measured.select(F.count(F.lit(1)), F.count_if("linked")).first()
        if joined:
            links = links.unionByName(measured.where("linked").select("a", "b"))
            found = materialize(components(links), "neardup-found")
        of = found.select(F.col("node").alias("rep"), "component")
        of_leader = found.select(F.col("node").alias("leader"), F.col("component").alias("joined"))
        state = led.join(of, "rep", "left").join(of_leader, "leader", "left").withColumn("component", F.coalesce("component", "rep"))
        apart = materialize(state.where(F.col("component") != F.coalesce("joined", "leader")).select("key", "rep", "n_shingles", "weight"), "neardup-apart")
        if LEADERS_JOIN * joined < compared or not compared:
            break

    # What is still in different components of one bucket, by a reference: the central class of its first leader's component.
    of = found.select(F.col("node").alias("rep"), "component")
    state = entries.join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    state = materialize(state, "neardup-state")
    open_keys = state.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    references = state.groupBy("component").agg(by_weight("rep").alias("ref"))
    of_key = materialize(first_leaders.join(open_keys, "key", "left_semi").join(state.select("key", F.col("rep").alias("leader"), "component"), ["key", "leader"]).join(references, "component").select("key", "ref"), "neardup-open")
    grouped = materialize(state.join(of_key, "key").select("ref", "rep", F.col("n_shingles").alias("n"), "component").distinct(), "neardup-grouped")
    rest = materialize(_close_pairs(grouped, sets), "neardup-rest")
    untested = grouped.where("rep <> ref").select(F.col("rep").alias("a"), F.col("ref").alias("b"))
    rest = rest.unionByName(untested.join(of.select(F.col("rep").alias("a"), F.col("component").alias("c")), "a", "left").join(of.select(F.col("rep").alias("b"), F.col("component").alias("d")), "b", "left").where("coalesce(c, a) <> coalesce(d, b)").select("a", "b"))
    more = _confirmed(rest, sets).where("linked").select("a", "b")
    # Rows that share a doc_id are one document.
    same_id = filled.groupBy("doc_id").agg(F.count_distinct("digest").alias("n")).where("n > 1").select("doc_id")
    own = filled.join(same_id, "doc_id", "left_semi").join(classes.select("digest", "rep"), "digest").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(more).unionByName(own))

    of = classes.select("digest", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    out = profile.drop("keys").join(of, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.least("component", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))


def first_of_each(docs: DataFrame) -> DataFrame:
    """The documents whose id is the smallest of their component, with their own columns."""
    kept = near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns)
