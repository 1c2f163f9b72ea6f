"""Benchmark decontamination by Wu-Manber multi-pattern search over word codes.

Patterns are windows of consecutive benchmark words.  A block is a run of two
or three words; the shift table says how far a scan may move when a block ends
at its position, so that most words of a clean text are never looked at.  Where
the shift is zero, the block's hash names a bucket of patterns, and each of
them is compared word by word.  Many stretches of text move in step, as arrays.

The benchmark is taken in blocks of at most ``block_words`` words; each is sent
to the executors as its own set of tables and scanned against all documents; what
it has found is written before the next block is built, so the memory is bounded
however large the benchmark is.  The comparison that confirms an occurrence is one
of 64-bit word codes.

Defined results: null and word-less texts have no words and no hits; benchmark
items that are null or without words are no patterns; items shorter than a
window are one pattern as a whole; repeated items and rows each count; further
columns, whatever their names, are kept by ``scan`` and ``clean_documents``; with an empty
benchmark nothing is hit.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import chunks, free_names, materialize, ship, text_buffers
from ._words import ALNUM, WordCodes, mix

TABLE_BITS = 20  #: size of the shift table, as a power of two
LANE = 256  #: words of a stretch that moves by itself


class PatternSet:
    """Shift table, buckets and words of all patterns of one length."""

    def __init__(self, patterns: np.ndarray, owners: list[np.ndarray]):
        self.length = patterns.shape[1]
        self.block = min(3, self.length)
        self.most = self.length - self.block + 1
        size = 1 << TABLE_BITS
        self.shift = np.full(size, self.most, np.uint8)
        for end in range(self.block - 1, self.length):
            at = self.slots(patterns[:, end - self.block + 1 : end + 1].T)
            np.minimum.at(self.shift, at, np.uint8(min(self.length - 1 - end, 255)))
        suffix = self.slots(patterns[:, -self.block :].T)
        order = np.argsort(suffix, kind="stable")
        self.patterns, self.suffix = patterns[order], suffix[order]
        counts = np.array([len(o) for o in owners], np.int64)[order]
        self.owner_at = np.append(0, np.cumsum(counts))
        self.owners = np.concatenate([owners[i] for i in order])

    def slots(self, block: np.ndarray) -> np.ndarray:
        """Table slot of blocks given as one array for each word of the block."""
        total = np.zeros(len(block[0]), np.uint64)
        for k, words in enumerate(block):
            total += words * np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) % (1 << 64))
        return (mix(total) >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every (position of last word, pattern) at which a pattern occurs in ``codes``."""
        n, none = len(codes), np.zeros(0, np.int64)
        if n < self.length:
            return none, none
        first = self.length - 1
        blocks = self.slots([codes[first - self.block + 1 + k : n - self.block + 1 + k] for k in range(self.block)])
        at = np.arange(0, len(blocks), LANE)
        stop = np.minimum(at + LANE, len(blocks))
        landed = []
        while len(at):
            step = self.shift[blocks[at]]
            landed.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        ends = np.concatenate(landed)
        low = np.searchsorted(self.suffix, blocks[ends], "left")
        many = np.searchsorted(self.suffix, blocks[ends], "right") - low
        ends, low, many = ends[many > 0] + first, low[many > 0], many[many > 0]
        found_at, found = [], []
        while len(ends):  # one pattern of each bucket at a time
            same = np.ones(len(ends), bool)
            for k in range(self.length):
                left = np.flatnonzero(same)
                if not len(left):
                    break
                same[left] = self.patterns[low[left], k] == codes[ends[left] - first + k]
            found_at.append(ends[same])
            found.append(low[same])
            more = many > 1
            ends, low, many = ends[more], low[more] + 1, many[more] - 1
        return (np.concatenate(found_at), np.concatenate(found)) if found else (none, none)


def pattern_sets(rows: list[tuple[str, str]], window: int) -> list[PatternSet]:
    """One set for each length that occurs: ``window``, and those of shorter items."""
    by_length: dict[int, dict[bytes, list[str]]] = defaultdict(lambda: defaultdict(list))
    codes_of = WordCodes(ALNUM)
    for item, text in rows:
        data = np.frombuffer((text or "").encode(), np.uint8)
        codes, _ = codes_of(data, np.array([0, len(data)]))
        size = min(window, len(codes))
        for k in range(len(codes) - size + 1 if size else 0):
            owners = by_length[size][codes[k : k + size].tobytes()]
            if not owners or owners[-1] != item:
                owners.append(item)
    return [PatternSet(np.array([np.frombuffer(p, np.uint64) for p in found]), [np.array(o, object) for o in found.values()]) for _, found in sorted(by_length.items())]


def scan(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = 2_000_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and three more: its words, those hit, and the occurring items' ids, sorted as strings.

    They are named ``n_words``, ``n_hit`` and ``items``, lengthened where ``docs`` has such a column.
    """
    names = free_names(docs, "n_words", "n_hit", "items")
    spark = docs.sparkSession
    ship(spark)
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text is not null and item is not null")
    words = items.select(F.sum(F.length("text"))).first()[0] or 0  # at least as many characters as words
    n_blocks = max(1, -(-words // (2 * block_words)))
    if n_blocks == 1:
        rows = [(r.item, r.text) for r in items.collect()]  # a block of the benchmark, of bounded size
        return _scan_block(docs, spark.sparkContext.broadcast(pattern_sets(rows, window)), text_col, names, last=True, first=True)
    out = docs
    for block in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == block)
        rows = [(r.item, r.text) for r in part.collect()]
        sets = spark.sparkContext.broadcast(pattern_sets(rows, window))
        # Written before the next block is built, so one block at a time is held by driver and executors.
        out = materialize(_scan_block(out, sets, text_col, names, last=block == n_blocks - 1, first=block == 0), "decontam-block")
        sets.unpersist()
    return out


def _scan_block(docs: DataFrame, sets, text_col: str, added: list[str], last: bool, first: bool) -> DataFrame:
    names = docs.columns
    text_at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes_of = WordCodes(ALNUM)
        for batch in batches:
            raw, at = text_buffers(batch.column(text_at))
            n_words, n_hit, all_hits, all_items = [], [], [], []
            for lo, hi in chunks(at):
                codes, starts = codes_of(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                hit = np.zeros(len(codes) + 1, np.int32)
                found: dict[int, set] = defaultdict(set)
                for patterns in sets.value:
                    ends, which = patterns.find(codes)
                    begins = ends - patterns.length + 1
                    doc = np.searchsorted(starts, begins, "right") - 1
                    within = ends < starts[doc + 1]  # a window lies in one document
                    begins, ends, which, doc = begins[within], ends[within], which[within], doc[within]
                    np.add.at(hit, begins, 1)
                    np.add.at(hit, ends + 1, -1)
                    for d, p in set(zip(doc.tolist(), which.tolist(), strict=True)):
                        found[d].update(patterns.owners[patterns.owner_at[p] : patterns.owner_at[p + 1]])
                marked = np.cumsum(hit[:-1]) > 0
                if not first:
                    for d in range(hi - lo):
                        before = batch.column(len(names) - 2)[lo + d].as_py()
                        marked[starts[d] : starts[d + 1]] |= np.unpackbits(np.frombuffer(before, np.uint8), count=int(starts[d + 1] - starts[d])).astype(bool)
                        found[d].update(batch.column(len(names) - 1)[lo + d].as_py())
                upto = np.append(0, np.cumsum(marked))
                n_words.extend(np.diff(starts).tolist())
                n_hit.extend((upto[starts[1:]] - upto[starts[:-1]]).tolist())
                all_items.extend(sorted(found[d]) if d in found else [] for d in range(hi - lo))
                if not last:
                    all_hits.extend(np.packbits(marked[a:b]).tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True))
            kept = batch.columns if first else batch.columns[:-2]
            items = pa.array(all_items, pa.list_(pa.string()))
            if last:
                new, labels = [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), items], added
            else:
                new, labels = [pa.array(all_hits, pa.binary()), items], added[1:]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[*batch.schema.names[: len(kept)], *labels])

    kept = docs.schema.fields if first else docs.schema.fields[:-2]
    from pyspark.sql import types as T

    items = T.StructField(added[2], T.ArrayType(T.StringType()))
    new = [T.StructField(added[0], T.LongType()), T.StructField(added[1], T.LongType()), items] if last else [T.StructField(added[1], T.BinaryType()), items]
    return docs.mapInArrow(run, T.StructType([*kept, *new]))


CONTAMINATED = "n_hit > 0 and 20 * n_hit >= n_words"


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: its words, those inside occurring windows, the items found, and the verdict."""
    found = scan(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        F.expr(CONTAMINATED).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any word of an occurring window, with their own columns.

    The share that ``CONTAMINATED`` asks for is a report's; a long document that holds
    one benchmark passage is no training text either.
    """
    found = scan(docs, benchmark)
    return found.where(F.col(f"`{found.columns[-2]}`") == 0).select(*[f"`{c}`" for c in docs.columns])
