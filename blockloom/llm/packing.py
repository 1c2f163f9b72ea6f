"""Packing of tokenised documents into fixed-length sequences by cutting-stock column generation.

A document of T ids fills T // L sequences alone.  Its tail of T mod L ids is an
item of that length.  The histogram of tail lengths (at most L - 1 numbers, the
only thing the driver sees) defines a cutting-stock problem: a linear program
over patterns, whose columns a knapsack dynamic program prices.  The rounded
multiplicities of the patterns that fill a sequence exactly are dealt to the
documents by their rank within their tail length.  Tails beyond those ranks lie
end to end in further sequences and are cut where a sequence ends; the last of
these is cut at powers of two, which need no padding.

Defined results: a null text counts as empty and is one piece holding only the
end id; repeated rows are packed each by itself; an empty table gives an empty
result; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import logging
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bpe import encoder, release
from ._shared import chunks, materialize, ship, sieve, sieved, text_buffers

MAX_PIVOTS = 4000  #: of the simplex method; any basis on the way is a valid packing, and what it lacks is reported
LP_GAP = 0.001  #: the program counts as solved within this share of its lower bound
LOG = logging.getLogger(__name__)

PIECES = "row_key string, doc_tokens long, all_crc32 long, pid int, full_before long, full_crc32 array<long>, tail int, tail_crc32 long"


def _token_batches(batches, path: str, end_id: int, id_at: int, text_at: int):
    """For each batch: ids of the texts with the end id, as (batch, row, ids)."""
    enc = encoder(path)
    tail = np.array([end_id], np.uint32)
    for batch in batches:
        _, at = text_buffers(batch.column(text_at))
        for lo, hi in chunks(at, 1 << 18):
            texts = [t or "" for t in batch.column(text_at).slice(lo, hi - lo).to_pylist()]
            ids, n = enc.encode(texts)
            stop = np.cumsum(n)
            for k in range(hi - lo):
                yield batch, lo + k, np.concatenate((ids[stop[k] - n[k] : stop[k]], tail))


def document_pieces(docs: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its number of ids, the checksums of its full pieces and of its tail.

    ``pid`` and ``full_before`` number the full pieces within a partition.
    """
    schema = docs.select(id_col).schema[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for _, row, ids in _token_batches([batch], tokenizer_path, end_id, 0, 1):
                raw = ids.astype("<u4").tobytes()
                full, tail = divmod(len(ids), length)
                crcs = [zlib.crc32(raw[4 * length * i : 4 * length * (i + 1)]) for i in range(full)]
                whole = zlib.crc32(raw)
                for x, v in zip(out, (f"{len(ids)}:{whole}", len(ids), whole, pid, before, crcs, tail, zlib.crc32(raw[4 * length * full :]) if tail else 0), strict=True):
                    x.append(v)
                before += full
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(out, kinds, strict=True))], names=["doc_id", *(c.split()[0] for c in PIECES.split(", "))])
        release()

    kind = schema.dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, {PIECES}")


# ---- the linear program ------------------------------------------------------


def knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int, most: int = 24) -> list[np.ndarray]:
    """Multisets of sizes within ``capacity`` worth more than 1, the best first.

    One table of best worths by room prices every size as the first of a pattern;
    up to ``most`` of the patterns so begun are returned, the optimum among them.
    """
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), "right").tolist()
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            worths = best[c - sizes[: upto[c]]] + worth[: upto[c]]
            k = worths.argmax()
            if worths[k] > best[c] + 1e-12:
                best[c], pick[c] = worths[k], k
    led = best[capacity - sizes] + worth
    columns, seen = [], set()
    for first in np.argsort(-led, kind="stable")[: 4 * most]:
        if led[first] <= 1 + 1e-7 or len(columns) == most:
            break
        counts, c = np.zeros(len(sizes)), capacity - sizes[first]
        counts[first] = 1
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                counts[pick[c]] += 1
                c -= sizes[pick[c]]
        if (key := counts.tobytes()) not in seen:
            seen.add(key)
            columns.append(counts)
    return columns


def fill_greedily(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns of the largest sizes that fit, each as often as what is left allows; uses up ``left``."""
    made = []
    while (left > 0).any():
        pattern, room = np.zeros(len(sizes), np.int64), capacity
        while len(fits := np.flatnonzero((left - pattern > 0) & (sizes <= room))):
            k = fits[-1]
            take = min(room // sizes[k], left[k] - pattern[k])
            pattern[k] += take
            room -= take * sizes[k]
        used = pattern > 0
        times = int((left[used] // pattern[used]).min())
        left[used] -= times * pattern[used]
        made.append((pattern, times))
    return made


def column_generation(counts: dict[int, int], capacity: int, max_pivots: int = MAX_PIVOTS, gap: float = LP_GAP, reached: dict | None = None) -> list[tuple[dict[int, int], int]]:
    """Patterns {size: number} of which each fills ``capacity`` exactly, with whole multiplicities.

    Together they use no size more often than ``counts`` has it.  ``reached`` gets the
    pivots, the program's value, its lower bound (the better one of the total size and
    the duals scaled by the best pattern's price) and whether it is solved.
    """
    sizes = np.array(sorted(s for s, n in counts.items() if n > 0 and 0 < s < capacity), np.int64)
    if not len(sizes):
        return []
    demand = np.array([counts[int(s)] for s in sizes], float)
    bound = float((sizes * demand).sum()) / capacity
    single = (capacity // sizes).astype(float)
    basis, inverse, x = np.diag(single), np.diag(1 / single), demand / single
    pivots, waiting = 0, [p.astype(float) for p, _ in fill_greedily(sizes, demand.astype(np.int64), capacity)][::-1]
    while pivots < max_pivots and x.sum() - bound > gap * bound:
        if not waiting:
            # Every pattern costs one sequence, so the dual prices are the column sums of the inverse.
            prices = inverse.sum(axis=0)
            waiting = knapsack(sizes, prices, capacity)[::-1]
            if not waiting:
                bound = float(x.sum())  # optimal
                break
            # No pattern is worth more than the best one, so prices over its worth are feasible duals.
            bound = max(bound, float(prices @ demand) / max(float(prices @ waiting[-1]), 1.0))
        column = waiting.pop()
        used = np.flatnonzero(column)
        if (inverse[:, used].sum(axis=0) * column[used]).sum() <= 1 + 1e-9:
            continue
        move = (inverse[:, used] * column[used]).sum(axis=1)
        up = move > 1e-9
        if not up.any():
            continue
        ratio = np.where(up, x / np.where(up, move, 1), np.inf)
        out = int(np.argmin(ratio))
        step = max(0.0, float(ratio[out]))
        x = np.maximum(x - step * move, 0)
        x[out] = step
        inverse[out] /= move[out]
        row = inverse[out].copy()
        touched = np.flatnonzero(row)
        move[out] = 0
        rows = np.flatnonzero(move)
        inverse[np.ix_(rows, touched)] -= np.outer(move[rows], row[touched])
        basis[:, out] = column
        pivots += 1
    if reached is not None:
        reached |= {"pivots": pivots, "value": float(x.sum()), "bound": bound, "solved": bool(x.sum() - bound <= gap * bound + 1e-9)}
    left, chosen = demand.astype(np.int64).copy(), []

    def choose(pattern: np.ndarray, times: int) -> None:
        used = pattern > 0
        times = min(times, int((left[used] // pattern[used]).min()))
        if times > 0:
            left[used] -= times * pattern[used]
            chosen.append(({int(s): int(a) for s, a in zip(sizes[used], pattern[used], strict=True)}, times))

    for k in np.argsort(-x, kind="stable"):
        pattern = np.rint(basis[:, k]).astype(np.int64)
        if (pattern * sizes).sum() == capacity:
            choose(pattern, int(np.floor(x[k] + 1e-6)))
    for pattern, times in fill_greedily(sizes, left.copy(), capacity):  # full patterns of what rounding has left
        if (pattern * sizes).sum() == capacity:
            choose(pattern, times)
    return chosen


def slot_table(chosen: list[tuple[dict[int, int], int]], counts: dict[int, int], capacity: int) -> dict:
    """For each size: the ranks that each pattern takes, and where the tails beyond them lie in the stream."""
    taken, slots, sequence = dict.fromkeys(counts, 0), {s: [] for s in counts}, 0
    for pattern, times in chosen:
        offset = 0
        for size, number in sorted(pattern.items()):
            slots[size].append((taken[size], number, sequence, offset))
            taken[size] += number * times
            offset += number * size
        sequence += times
    stream, start = {}, 0
    for size in sorted(counts):
        stream[size] = start
        start += size * (counts[size] - taken[size])
    return {"slots": slots, "taken": taken, "stream": stream, "stream_tokens": start, "sequences": sequence}


def last_cuts(tokens: int, capacity: int) -> list[int]:
    """Ends of the stream's sequences past its last full one: its rest as a sum of powers of two."""
    at, rest, ends = tokens - tokens % capacity, tokens % capacity, []
    for bit in range(capacity.bit_length(), -1, -1):
        if rest >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


# ---- the operator -----------------------------------------------------------


def pack(docs: DataFrame, tokenizer_path: str, length: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of all documents."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    base = materialize(document_pieces(docs, tokenizer_path, length, end_id, id_col, text_col), "pack-pieces")
    tails = base.filter("tail > 0")
    counts = {r[0]: r[1] for r in tails.groupBy("tail").count().collect()}  # at most length - 1 rows
    reached: dict = {}
    table = slot_table(column_generation(counts, length, reached=reached), counts, length)
    LOG.info("packing %d tails of %d lengths: %s", sum(counts.values()), len(counts), reached)

    # Ranks within a tail length: range-partitioned, so a common length spreads over partitions.
    def local_rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            tail = batch.column(batch.schema.get_field_index("tail")).to_numpy()
            first = np.flatnonzero(np.append(True, tail[1:] != tail[:-1])) if len(tail) else np.zeros(0, np.int64)
            rank = np.arange(len(tail)) - np.repeat(first, np.diff(np.append(first, len(tail))))
            if len(tail) and tail[0] == last:
                rank[: first[1] if len(first) > 1 else len(tail)] += n
            if len(tail):
                last, n = tail[-1], int(rank[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(tail), pid), pa.int32()), pa.array(rank, pa.int64())], names=[*batch.schema.names, "rpid", "rank"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = tails.select("doc_id", "row_key", "doc_tokens", "tail", "tail_crc32")
    ordered = slim.repartitionByRange(parts, "tail", "doc_id", "row_key").sortWithinPartitions("tail", "doc_id", "row_key")
    ranked = materialize(ordered.mapInArrow(local_rank, f"doc_id {kind}, row_key string, doc_tokens long, tail int, tail_crc32 long, rpid int, rank long"), "pack-ranks")
    base_rank, seen = {}, dict.fromkeys(counts, 0)
    for pid, tail, n in sorted(tuple(r) for r in ranked.groupBy("rpid", "tail").agg(F.max("rank") + 1).collect()):  # partitions + lengths rows
        base_rank[pid, tail] = seen[tail]
        seen[tail] += n

    stream_full = table["stream_tokens"] // length
    ends = last_cuts(table["stream_tokens"], length)
    stream_base = table["sequences"]
    full_base = stream_base + stream_full + len(ends)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each piece of a tail; pieces that are not the whole tail have no checksum yet."""
        slot_starts = {s: np.array([x[0] for x in v]) for s, v in table["slots"].items()}
        for batch in batches:
            rows = []
            for doc, key, tokens, tail, crc, pid, rank in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rank += base_rank[pid, tail]
                start = tokens - tail
                if rank < table["taken"][tail]:
                    k = int(np.searchsorted(slot_starts[tail], rank, "right")) - 1
                    low, number, sequence, offset = table["slots"][tail][k]
                    copy, slot = divmod(rank - low, number)
                    rows.append((doc, key, start, tail, crc, tokens, sequence + copy, offset + slot * tail))
                    continue
                at = table["stream"][tail] + (rank - table["taken"][tail]) * tail
                stop, begin = at + tail, at
                while begin < stop:
                    if begin < stream_full * length:
                        sequence, opens = divmod(begin, length)[0], begin // length * length
                        closes = opens + length
                    else:
                        j = next(i for i, e in enumerate(ends) if e > begin)
                        sequence, opens, closes = stream_full + j, ends[j - 1] if j else stream_full * length, ends[j]
                    size = min(stop, closes) - begin
                    rows.append((doc, key, start + begin - at, size, crc if size == tail else None, tokens, stream_base + sequence, begin - opens))
                    begin += size
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = (batch.schema.field(0).type, pa.string(), *(pa.int64(),) * 6)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "row_key", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    piece = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    placed = materialize(ranked.mapInArrow(place, f"doc_id {kind}, row_key string, {piece}"), "pack-tails")
    whole = placed.filter("ids_crc32 is not null").drop("row_key")
    cut = placed.filter("ids_crc32 is null")

    # Cut tails need their ids once more: only those documents are encoded again.
    ids = materialize(cut.select("doc_id").distinct(), "pack-cut")
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    again = sieved(named, sieve(ids, "doc_id"), "wanted", "doc_id").where("wanted").drop("wanted").join(ids, "doc_id", "left_semi")

    def tail_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ids = [], []
            for _, _, x in _token_batches([batch], tokenizer_path, end_id, 0, 1):
                raw = x.astype("<u4").tobytes()
                keys.append(f"{len(x)}:{zlib.crc32(raw)}")
                ids.append(raw[len(raw) - 4 * (len(x) % length) :])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.string()), pa.array(ids, pa.binary())], names=["doc_id", "row_key", "ids"])
        release()

    tails_again = again.mapInArrow(tail_ids, f"doc_id {kind}, row_key string, ids binary").dropDuplicates(["doc_id", "row_key"])
    cut = cut.drop("ids_crc32").join(tails_again, ["doc_id", "row_key"])
    crc = F.crc32(F.expr(f"substring(ids, cast(4 * (start - (doc_tokens - pmod(doc_tokens, {length}))) + 1 as int), cast(4 * length as int))"))
    cut = cut.withColumn("ids_crc32", crc).select(whole.columns)

    before, total = [], full_base  # a number for each partition of the tokenised table
    for pid, n in sorted(tuple(r) for r in base.groupBy("pid").agg(F.sum(F.size("full_crc32"))).collect()):
        before.append((pid, total))
        total += n
    starts = spark.createDataFrame(before, "pid int, first long")
    full = base.filter("size(full_crc32) > 0").join(F.broadcast(starts), "pid").select("doc_id", "doc_tokens", (F.col("first") + F.col("full_before")).alias("first"), F.posexplode("full_crc32").alias("k", "ids_crc32"))
    full = full.select("doc_id", (F.col("k") * F.lit(length).cast("long")).alias("start"), F.lit(length).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return full.unionByName(whole).unionByName(cut)
