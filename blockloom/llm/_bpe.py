"""Byte-level BPE over whole batches.

The split into pre-tokens is found with array operations on code points; each
distinct pre-token is encoded once per worker by the tokenizer library, and the
ids of a text are gathered from that table.  The result equals encoding each
text by itself.
"""

from __future__ import annotations

import unicodedata

import numpy as np

#: Fixed values of the public pre-token pattern: contractions split off after an apostrophe.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Code points with the Unicode property White_Space.
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
CACHE_ENTRIES = 1 << 20

_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    global _classes
    if _classes is None:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        table[list(SPACES)] = SPACE
        _classes = table
    return _classes


def pretoken_starts(cp: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Start of every pre-token in the code points ``cp``; ``bounds`` are the texts' starts and the end."""
    n = len(cp)
    kind = classes()[cp]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    last = first[1:]
    run = first[:-1].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = run.copy()
    space = kind == SPACE
    # The last white space before a visible character stands apart from the run before it.
    ends_run = np.zeros(n, bool)
    ends_run[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
    start |= ends_run
    # A plain blank there joins the token that follows.
    joins = np.flatnonzero(ends_run & (cp == 0x20))
    start[joins + 1] = False
    # Contractions: a lone apostrophe at a token's start, then certain letters.
    quotes = np.flatnonzero((cp == 0x27) & start)
    if len(quotes):
        size = len(cp)
        for q in quotes.tolist():
            if q + 1 >= size or first[q + 1] or kind[q + 1] != LETTER:
                continue
            stop = q + 1
            while stop < min(q + 3, size) and not (first[stop]) and kind[stop] == LETTER:
                stop += 1
            following = "".join(map(chr, cp[q + 1 : stop]))
            for c in CONTRACTIONS:
                if following.startswith(c):
                    start[q + 1] = False
                    rest = q + 1 + len(c)
                    if rest < size and not first[rest] and kind[rest] == LETTER:
                        start[rest] = True
                    break
    return np.flatnonzero(start)


def piece_encoder(path: str):
    """A quicker encoder of single pre-tokens, where the file's merges are ranked by id; else None."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
    order = [vocab.get(m, -1) for m in merged]
    if -1 in order or any(a >= b for a, b in zip(order, order[1:])) or order[0] < 256:
        return None
    # Byte-level alphabets write printable bytes as themselves and the others from U+0100 on.
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if all(c in byte for c in token) and i < 256}
    known = set(order)
    ranks |= {bytes(byte[c] for c in token): i for token, i in vocab.items() if i in known}
    if len(ranks) != 256 + len(known):
        return None
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})


class BatchEncoder:
    """ids of texts, with a table of the pre-tokens met so far."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = piece_encoder(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        rng = np.random.Generator(np.random.PCG64(7))
        self.weight = rng.integers(1, 2**63, 0x110000, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.p = np.uint64(0x9E3779B97F4A7C15 | 1)
        self.q = np.uint64(pow(int(self.p), -1, 1 << 64))
        self.powers = self.inverse = np.zeros(0, np.uint64)
        self.clear()

    def clear(self) -> None:
        self.mask = np.uint64(2 * CACHE_ENTRIES - 1)
        self.keys = np.zeros(2 * CACHE_ENTRIES, np.uint64)
        self.slot = np.full(2 * CACHE_ENTRIES, -1, np.int32)
        self.at = np.zeros(1 << 12, np.int64)
        self.ids = np.zeros(1 << 13, np.uint32)
        self.n = self.used = 0

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, 1 << 18)
            with np.errstate(over="ignore"):
                self.powers, self.inverse = np.full(n, self.p, np.uint64), np.full(n, self.q, np.uint64)
                for table in (self.powers, self.inverse):
                    table[0] = 1
                    np.cumprod(table, out=table)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entry of each hash, -1 where unknown."""
        found = np.full(len(hashes), -1, np.int32)
        todo = np.arange(len(hashes))
        place = (hashes ^ (hashes >> np.uint64(32))) & self.mask
        while len(todo):
            slot = self.slot[place]
            hit = (slot >= 0) & (self.keys[place] == hashes[todo])
            found[todo[hit]] = slot[hit]
            more = (slot >= 0) & ~hit
            todo, place = todo[more], (place[more] + np.uint64(1)) & self.mask
        return found

    def _add(self, hashes: np.ndarray, pieces: list[str]) -> None:
        if self.pieces is not None:
            batch = [self.pieces.encode_ordinary(p) for p in pieces]
        else:
            batch = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        for h, ids in zip(hashes.tolist(), batch, strict=True):
            place = (h ^ (h >> 32)) & int(self.mask)
            while self.slot[place] >= 0:
                place = (place + 1) & int(self.mask)
            self.keys[place], self.slot[place] = h, self.n
            if self.n + 2 > len(self.at):
                self.at = np.concatenate((self.at, np.zeros_like(self.at)))
            while self.used + len(ids) > len(self.ids):
                self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
            self.ids[self.used : self.used + len(ids)] = ids
            self.used += len(ids)
            self.n += 1
            self.at[self.n] = self.used

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and the number of ids of each."""
        odd = [i for i, t in enumerate(texts) if any(s in t for s in self.special)]
        if odd:  # a special token's string inside a text is that token, as the library reads it
            plain = [i for i in range(len(texts)) if i not in set(odd)]
            parts: list = [None] * len(texts)
            if plain:
                ids, n = self.encode([texts[i] for i in plain])
                for i, part in zip(plain, np.split(ids, np.cumsum(n)[:-1]), strict=True):
                    parts[i] = part
            for i in odd:
                parts[i] = np.array(self.tokenizer.encode(texts[i], add_special_tokens=False).ids, np.uint32)
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        whole = "".join(texts)
        bounds = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=bounds[1:])
        if not whole:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        cp = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        starts = pretoken_starts(cp, bounds)
        ends = np.append(starts[1:], len(cp))
        self._grow(len(cp) + 1)
        with np.errstate(over="ignore"):
            total = np.zeros(len(cp) + 1, np.uint64)
            np.cumsum(self.weight[cp] * self.powers[: len(cp)], out=total[1:])
            hashes = (total[ends] - total[starts]) * self.inverse[starts]
            hashes ^= hashes >> np.uint64(29)
            hashes *= np.uint64(0xBF58476D1CE4E5B9)
            hashes ^= hashes >> np.uint64(32)
        entry = self._find(hashes)
        new = np.flatnonzero(entry < 0)
        if len(new):
            distinct, where = np.unique(hashes[new], return_index=True)
            if self.n + len(distinct) > CACHE_ENTRIES:
                self.clear()
                distinct, where = np.unique(hashes, return_index=True)
                new = np.arange(len(hashes))
            if len(distinct) > CACHE_ENTRIES:  # one very long text: in halves of texts or, alone, without the table
                if len(texts) == 1:
                    e = self.tokenizer.encode(texts[0], add_special_tokens=False)
                    return np.array(e.ids, np.uint32), np.array([len(e.ids)], np.int64)
                half = len(texts) // 2
                (a, an), (b, bn) = self.encode(texts[:half]), self.encode(texts[half:])
                return np.concatenate((a, b)), np.concatenate((an, bn))
            where = new[where]
            self._add(distinct, [whole[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            entry[new] = self._find(hashes[new])
        begin = self.at[entry]
        count = self.at[entry + 1] - begin
        stop = np.cumsum(count)
        ids = self.ids[np.arange(stop[-1]) + np.repeat(begin - (stop - count), count)]
        owner = np.searchsorted(starts, bounds)  # first pre-token of each text
        upto = np.append(0, stop)[owner]
        return ids, np.diff(upto)


_encoders: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    if path not in _encoders:
        _encoders[path] = BatchEncoder(path)
    return _encoders[path]


def release() -> None:
    """Gives the encoders' memory back: workers outlive the task and serve other stages."""
    import ctypes
    import gc

    _encoders.clear()
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
