"""Byte-level BPE of whole Arrow batches with numpy matrices.

A batch's texts become one code point array; the pre-tokeniser's pattern is worked out on
character classes of the whole array. Equal pieces of a batch are encoded once: their bytes fill
padded matrices, one per range of lengths, in which every row merges its leftmost pair of the
least rank each round (long rows: all of that pair's places, which gives the same ids, since a
merged token only takes part in merges of higher rank). Pairs are looked up in an open-addressing
hash table of (left id, right id); finished rows leave the matrix.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidescribe.llm import textops

#: Where the public vocabularies lie; a parameter of every function that needs one.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: White space of the pre-tokeniser's pattern (Unicode White_Space) — fixed values.
SPACES = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that the pattern splits off after an apostrophe — fixed values.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
NONE = np.int32(2**31 - 1)
LONG = 48  # bytes from which a round merges all places of a row's best pair


@functools.cache
def class_table() -> np.ndarray:
    """Pre-tokeniser class of every code point."""
    cat = textops.category_table()
    t = np.full(len(cat), OTHER, dtype=np.uint8)
    t[cat == ord("L")] = LETTER
    t[cat == ord("N")] = NUMBER
    t[SPACES] = SPACE
    return t


def piece_starts(a: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Flags of the code points at which a piece begins; ``rows`` are row offsets."""
    n = len(a)
    if n == 0:
        return np.zeros(0, dtype=bool)
    c = class_table()[a]
    edge = np.zeros(n + 1, dtype=bool)
    edge[rows] = True  # also the end
    row_start, row_end = edge[:n], edge[1:]
    prev = np.concatenate([[OTHER], c[:-1]])
    blank = a == 0x20
    prev_blank = np.concatenate([[False], blank[:-1]]) & ~row_start
    start = row_start | ((c != prev) & ~prev_blank)
    space = c == SPACE
    next_solid = np.zeros(n, dtype=bool)
    next_solid[:-1] = ~space[1:]
    next_solid &= ~row_end
    start |= space & next_solid  # the last of a run of spaces goes with what follows or stands alone
    start |= space & np.concatenate([[True], ~space[:-1]])
    apostrophe = np.flatnonzero(a == 0x27)
    if len(apostrophe):
        p = prev[apostrophe]
        free = row_start[apostrophe] | (p == LETTER) | (p == NUMBER) | ((p == SPACE) & ~prev_blank[apostrophe])
        apostrophe = apostrophe[free]
        limit = rows[np.searchsorted(rows, apostrophe, side="right")]
        done = np.zeros(len(apostrophe), dtype=bool)
        for word in CONTRACTIONS:
            hit = ~done & (apostrophe + len(word) < limit)
            for i, ch in enumerate(word, 1):
                hit[hit] = a[apostrophe[hit] + i] == ord(ch)
            at = apostrophe[hit]
            start[at] = True
            for i in range(1, len(word) + 1):
                start[at + i] = False
            after = at + len(word) + 1
            after = after[after < n]
            start[after] = True
            done |= hit
    return start


class PairTable:
    """Rank of every pair of tokens whose joint bytes are a token, by hashing."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x, dtype=np.int64) for x in zip(*pairs))
        key = (left << 32) | right
        self.bits = int(len(key) * 4 - 1).bit_length()
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int32)
        slot, left_over = self._slot(key), np.arange(len(key))
        self.probes = 0
        while len(left_over):
            self.probes += 1
            free = left_over[self.keys[slot[left_over]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            placed = free[first]
            self.keys[slot[placed]] = key[placed]
            self.ranks[slot[placed]] = rank[placed]
            left_over = np.setdiff1d(left_over, placed, assume_unique=True)
            slot[left_over] = (slot[left_over] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(textops.BASE)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where there is none or an id is negative (padding)."""
        key = (left.astype(np.int64) << 32) | (right.astype(np.int64) & 0xFFFFFFFF)
        flat = key.ravel()
        slot = self._slot(flat)
        held = self.keys[slot]
        out = np.where(held == flat, self.ranks[slot], NONE)
        open_ = np.flatnonzero((held != flat) & (held != -1))
        for _ in range(self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            held = self.keys[slot[open_]]
            hit = held == flat[open_]
            out[open_[hit]] = self.ranks[slot[open_[hit]]]
            open_ = open_[~hit & (held != -1)]
        return out.reshape(key.shape)


@functools.cache
def pair_table(path: str) -> PairTable:
    return PairTable(path)


def merge_rows(ids: np.ndarray, size: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge padded rows of ids to the end; ``size`` are their lengths. Returns the same two."""
    n, width = ids.shape
    out = np.full((n, width), -1, dtype=np.int32)
    out_size = size.copy()
    live = np.arange(n)
    rank = table.look(ids[:, :-1], ids[:, 1:]) if width > 1 else np.full((n, 0), NONE, dtype=np.int32)
    while len(live):
        if rank.shape[1] == 0:
            out[live, : ids.shape[1]] = ids
            out_size[live] = size
            break
        best = rank.min(axis=1)
        over = best == NONE
        if over.any():
            out[live[over], : ids.shape[1]] = ids[over]
            out_size[live[over]] = size[over]
            keep = ~over
            live, ids, rank, size, best = live[keep], ids[keep], rank[keep], size[keep], best[keep]
            if not len(live):
                break
        if ids.shape[1] < LONG:
            at = rank.argmin(axis=1)
            r = np.arange(len(live))
            ids[r, at] = best
            column = np.arange(ids.shape[1] - 1)
            shift = column[None, :] > at[:, None]  # close the gap: all to the right move one left
            ids[:, :-1] = np.where(shift, ids[:, 1:], ids[:, :-1])
            ids[:, -1] = -1
            if rank.shape[1] > 1:
                rank[:, :-1] = np.where(shift[:, :-1], rank[:, 1:], rank[:, :-1])
            rank[:, -1] = NONE
            rank[r, at] = np.where(at + 1 < ids.shape[1], table.look(best, ids[r, np.minimum(at + 1, ids.shape[1] - 1)]), NONE)
            back = at > 0
            rank[r[back], at[back] - 1] = table.look(ids[r[back], at[back] - 1], best[back])
            size = size - 1
        else:
            hit = rank == best[:, None]
            column = np.arange(hit.shape[1])
            off = np.maximum.accumulate(np.where(~hit, column, -1), axis=1)  # the last place before that isn't one
            hit &= ((column - off) & 1) == 1
            ids[:, :-1] = np.where(hit, best[:, None], ids[:, :-1])
            keep = ids >= 0
            keep[:, 1:] &= ~hit
            size = keep.sum(axis=1)
            inside = np.arange(int(size.max()))[None, :] < size[:, None]
            packed, moved, changed = np.full(inside.shape, -1, dtype=np.int32), np.full(inside.shape, NONE), np.zeros(inside.shape, dtype=bool)
            packed[inside] = ids[keep]
            moved[:, : rank.shape[1] + 1][inside] = np.pad(rank, ((0, 0), (0, 1)), constant_values=NONE)[keep]
            changed[inside] = np.pad(hit, ((0, 0), (0, 1)))[keep]
            ids, rank = packed, moved[:, :-1]
            again = (changed[:, :-1] | changed[:, 1:]) & inside[:, 1:]
            rank[again] = table.look(ids[:, :-1][again], ids[:, 1:][again])
            rank[~inside[:, 1:]] = NONE
            continue
        widest = int(size.max())
        if widest < ids.shape[1]:
            ids, rank = np.ascontiguousarray(ids[:, :widest]), np.ascontiguousarray(rank[:, : max(0, widest - 1)])
    return out, out_size


def encode_pieces(data: np.ndarray, start: np.ndarray, length: np.ndarray, table: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of pieces of the bytes ``data``: all ids in one array, and each piece's offset (n + 1)."""
    count = np.ones(len(start), dtype=np.int64)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    edges = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 96, 192, 384, 768]
    top = int(length.max()) if len(length) else 0
    while edges[-1] < top:
        edges.append(edges[-1] * 2)
    low = 0
    for high in edges:
        group = np.flatnonzero((length > low) & (length <= high))
        low = high
        step = max(1, 4_000_000 // high)
        for i in range(0, len(group), step):
            g = group[i : i + step]
            column = np.arange(high)
            inside = column[None, :] < length[g][:, None]
            at = np.minimum(start[g][:, None] + column[None, :], len(data) - 1)
            ids = np.where(inside, table.byte_id[data[at]], np.int32(-1))
            ids, size = merge_rows(ids, length[g].copy(), table)
            count[g] = size
            parts.append((g, ids, size))
    count[length == 0] = 0
    offsets = np.concatenate([[0], np.cumsum(count)])
    flat = np.empty(offsets[-1], dtype=np.int32)
    for g, ids, size in parts:
        column = np.arange(ids.shape[1])
        inside = column[None, :] < size[:, None]
        flat[(offsets[g][:, None] + column[None, :])[inside]] = ids[inside]
    return flat, offsets


def encode_batch(col: pa.Array, path: str = VOCABULARY) -> pa.ListArray:
    """Token ids of every text of a batch; an empty or null text gives an empty list."""
    col = textops.strings(col)
    a, rows = textops.batch_codes(col)
    if len(a) == 0:
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(col) + 1, dtype=np.int32)), pa.array([], type=pa.int32()))
    at = np.flatnonzero(piece_starts(a, rows))
    end = np.append(at[1:], len(a))
    key = textops.window_hash(textops.prefix_hash(a), at, end)
    distinct, first, which = np.unique(key, return_index=True, return_inverse=True)
    known = piece_cache(path)
    new = ~known.has(distinct)
    if new.any():
        width = (a >= 0x80).astype(np.int8) + (a >= 0x800) + (a >= 0x10000) + 1
        byte_at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
        data = np.frombuffer("".join(col.to_pylist()).encode("utf-8", "surrogatepass"), dtype=np.uint8)
        s, e = byte_at[at[first[new]]], byte_at[end[first[new]]]
        known.add(distinct[new], *encode_pieces(data, s, e - s, pair_table(path)))
    flat, begin, length = known.find(distinct)
    known.trim()
    size = length[which]
    total = np.concatenate([[0], np.cumsum(size)])
    index = np.arange(total[-1]) - np.repeat(total[:-1] - begin[which], size)
    bounds = total[np.searchsorted(at, rows)]
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat[index]))


class PieceCache:
    """Ids of pieces this worker has met, by the piece's 64-bit hash; forgets all beyond a size."""

    LIMIT = 4_000_000  # ids held

    def __init__(self):
        self.keys, self.begin, self.length = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), dtype=bool)
        return self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] == keys

    def add(self, keys: np.ndarray, flat: np.ndarray, offsets: np.ndarray) -> None:
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.begin = np.insert(self.begin, at, offsets[:-1] + len(self.flat))
        self.length = np.insert(self.length, at, np.diff(offsets))
        self.flat = np.concatenate([self.flat, flat])

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        return self.flat, self.begin[at], self.length[at]

    def trim(self) -> None:
        if len(self.flat) > self.LIMIT:
            self.__init__()


@functools.cache
def piece_cache(path: str) -> PieceCache:
    return PieceCache()


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``key`` and ``ids`` (array<int>) of every row; no shuffle, one pass.

    Empty and null texts give an empty list; a null key is kept. Very long texts and runs are
    encoded whole. Other columns don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = max(1, batch.column(1).nbytes)
            step = max(1, int(batch.num_rows * min(1.0, 3_000_000 / size)))
            for i in range(0, batch.num_rows, step):  # bounded work memory whatever the texts' lengths
                part = batch.slice(i, step)
                ids = encode_batch(part.column(1), vocabulary)
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    rows = df.select(F.col(key), F.col(text).cast("string"))
    return rows.mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def p8_ids(spark, sf_dir: str) -> DataFrame:
    """Ids of each document by byte_bpe_50k, without special tokens."""
    return encode_corpus(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
