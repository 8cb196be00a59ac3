"""Byte-level BPE encoding and decoding on padded numpy matrices.

Texts are cut into pieces (``pretoken.py``). The distinct pieces of a block
are sorted by length into buckets, each bucket a padded matrix of token ids
that starts as bytes. In every round each row finds the rank of all its
adjacent pairs by a hashed lookup, merges its leftmost pair of the least
rank and closes the gap; rows without a mergeable pair leave the matrix.
Long rows merge all disjoint occurrences of that pair in one round, which
ends in the same tokens: a token made by a merge only takes part in merges
of higher rank.

Null text counts as empty, which has no ids and decodes to no bytes; extra
columns are ignored; rows that repeat a doc_id each give a row; an empty
table gives an empty result. Memory per task is bounded by a block of whole
texts plus the table of ranks.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as T
from .pretoken import pieces
from .stages import keyed_text

NO_PAIR = np.int32(2**31 - 1)
#: Rows of at most this many bytes merge one pair a round.
SHORT = 48
#: Cells of one matrix.
CELLS = 1 << 20


class Ranks:
    """A rank file: token bytes by id, and a hashed table from pairs of ids to
    the id they merge into."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            by_bytes = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.n = max(by_bytes.values()) + 1
        byte = np.zeros(256, np.int32)
        for i in range(256):
            byte[i] = by_bytes[bytes([i])]
        self.byte_ids = byte
        tokens = sorted((i, t) for t, i in by_bytes.items())
        lengths = np.zeros(self.n + 1, np.int64)
        for i, t in tokens:
            lengths[i + 1] = len(t)
        self.token_at = np.cumsum(lengths)
        self.token_bytes = np.frombuffer(b"".join(t for _, t in tokens), np.uint8)
        pairs = [(by_bytes[t[:k]] << 32 | by_bytes[t[k:]], i) for i, t in tokens for k in range(1, len(t))
                 if t[:k] in by_bytes and t[k:] in by_bytes]
        self._index(np.array([p for p, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int32))

    def _index(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """Open addressing with linear probes, filled in vectorised turns."""
        size = 1 << int(np.ceil(np.log2(max(len(keys), 1) * 4)))
        self.mask = size - 1
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NO_PAIR, np.int32)
        slot, left = self._slot(keys), np.arange(len(keys))
        while len(left):
            s = slot[left]
            free = self.keys[s] == -1
            turn, where = np.unique(s[free], return_index=True)
            placed = left[free][where]
            self.keys[turn], self.ranks[turn] = keys[placed], ranks[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            slot[left] = (slot[left] + (self.keys[slot[left]] != -1)) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(32))) & np.uint64(self.mask)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids; NO_PAIR if it does not merge. A right or
        left id of -1 (padding) never merges."""
        key = (left.astype(np.int64) << 32 | (right.astype(np.int64) & 0xFFFFFFFF)).ravel()
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NO_PAIR)
        more = np.flatnonzero((found != key) & (found != -1))
        while len(more):
            slot[more] = (slot[more] + 1) & self.mask
            found = self.keys[slot[more]]
            hit = found == key[more]
            out[more[hit]] = self.ranks[slot[more[hit]]]
            more = more[~hit & (found != -1)]
        return out.reshape(left.shape)

    # ---- encoding ---------------------------------------------------------

    def encode_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces one after the other, and each piece's offset."""
        length = ends - starts
        order = np.argsort(length, kind="stable")
        sizes = np.zeros(len(starts), np.int64)
        found = []
        lo = 0
        while lo < len(order):
            width = int(length[order[lo]])
            top = int(width * 1.25) + 1  # a bucket of lengths: little padding
            hi = lo + int(np.searchsorted(length[order[lo:]], top, "right"))
            hi = min(hi, lo + max(1, CELLS // max(int(length[order[min(hi, len(order)) - 1]]), 1)))
            rows = order[lo:hi]
            ids, n = self._merge(data, starts[rows], length[rows])
            sizes[rows] = n
            found.append((rows, ids))
            lo = hi
        at = np.concatenate([[0], np.cumsum(sizes)])
        out = np.empty(int(at[-1]), np.int32)
        for rows, ids in found:
            out[ragged(at[rows], sizes[rows])] = ids
        return out, at

    def _merge(self, data, starts, length) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the rows of one bucket, one after the other, and their number."""
        width = int(length.max()) if len(length) else 0
        column = np.arange(width)
        inside = column < length[:, None]
        grid = np.full((len(starts), width), -1, np.int32)
        grid[inside] = self.byte_ids[data[ragged(starts, length)]]
        size = length.copy()
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live = np.arange(len(starts))
        rank = self.pair_ranks(grid[:, :-1], grid[:, 1:]) if width > 1 else np.zeros((len(starts), 0), np.int32)
        while len(live):
            if grid.shape[1] > 1:
                at = rank.argmin(axis=1)
                best = rank[np.arange(len(live)), at]
            else:
                at, best = np.zeros(len(live), np.int64), np.full(len(live), NO_PAIR)
            stop = best == NO_PAIR
            if stop.any():
                done.append((live[stop], grid[stop], size[stop]))
                go = ~stop
                live, grid, size, at, best, rank = live[go], grid[go], size[go], at[go], best[go], rank[go]
                if not len(live):
                    break
            if width <= SHORT:
                grid, size, rank = self._leftmost(grid, size, rank, at, best)
            else:
                grid, size, rank = self._everywhere(grid, size, rank, best)
        ids = np.concatenate([g[np.arange(g.shape[1]) < n[:, None]] for _, g, n in done]) if done else np.zeros(0, np.int32)
        rows = np.concatenate([r for r, _, _ in done]) if done else np.zeros(0, np.int64)
        counts = np.concatenate([n for _, _, n in done]) if done else np.zeros(0, np.int64)
        total = np.zeros(len(starts), np.int64)
        total[rows] = counts
        begin = np.cumsum(total) - total
        out = np.empty(len(ids), np.int32)
        out[ragged(begin[rows], counts)] = ids
        return out, total

    def _leftmost(self, grid, size, rank, at, best):
        """Merge one pair a row: drop the pair's right column, and look up the
        two pairs that the new token stands in."""
        rows, width = np.arange(len(grid)), grid.shape[1]
        column = np.arange(width - 1)
        source = column + (column > at[:, None])
        grid = np.take_along_axis(grid, source, axis=1)
        grid[rows, at] = best
        size = size - 1
        if width <= 2:
            return grid, size, np.zeros((len(grid), 0), np.int32)
        rank = np.take_along_axis(rank, source[:, :-1] if width > 2 else source, axis=1)
        right = np.flatnonzero(at < width - 2)
        rank[right, at[right]] = self.pair_ranks(grid[right, at[right]], grid[right, at[right] + 1])
        left = np.flatnonzero(at > 0)
        rank[left, at[left] - 1] = self.pair_ranks(grid[left, at[left] - 1], grid[left, at[left]])
        return grid, size, rank

    def _everywhere(self, grid, size, rank, best):
        """Merge every disjoint occurrence of each row's least pair, counting
        them from the left where they overlap."""
        hit = rank == best[:, None]
        # in a run of overlapping occurrences take every other one
        run = np.zeros(hit.shape, np.int32)
        idle = np.where(hit, -1, np.arange(hit.shape[1]))
        run = np.arange(hit.shape[1]) - np.maximum.accumulate(idle, axis=1) - 1
        take = hit & (run % 2 == 0)
        keep = np.ones(grid.shape, bool)
        keep[:, 1:] = ~take
        grid = grid.copy()
        row, col = np.nonzero(take)
        grid[row, col] = best[row]
        keep &= grid >= 0
        size = keep.sum(axis=1)
        width = int(size.max())
        packed = np.full((len(grid), width), -1, np.int32)
        packed[np.arange(width) < size[:, None]] = grid[keep]
        rank = self.pair_ranks(packed[:, :-1], packed[:, 1:]) if width > 1 else np.zeros((len(grid), 0), np.int32)
        return packed, size, rank

    # ---- decoding ---------------------------------------------------------

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a run of ids."""
        return self.token_bytes[ragged(self.token_at[ids], self.token_at[ids + 1] - self.token_at[ids])]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[i] .. starts[i] + sizes[i] - 1 for all i, in a row."""
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


_loaded: dict[str, Ranks] = {}


def ranks(path: str) -> Ranks:
    """The rank table of a file, read once per Python worker."""
    if path not in _loaded:
        _loaded[path] = Ranks(path)
    return _loaded[path]


def encode_block(data: np.ndarray, offsets: np.ndarray, table: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a block, and the offset of each text's first id."""
    starts, ends, first = pieces(data, offsets)
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
    one, number = T.distinct_spans(data, starts, ends)
    ids, at = table.encode_pieces(data, starts[one], ends[one])
    sizes = np.diff(at)[number]
    out = ids[ragged(at[:-1][number], sizes)]
    return out, np.concatenate([[0], np.cumsum(sizes)])[first]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) for every text."""
    def run(batches):
        table = ranks(path)
        for rows, data, offsets in T.blocks(batches):
            ids, first = encode_block(data, offsets, table)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))], names=["doc_id", "ids"])

    return keyed_text(docs).mapInArrow(run, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, bytes for every row of ``encode``; null ids give no bytes."""
    def run(batches):
        table = ranks(path)
        for batch in batches:
            out = [table.decode(np.array(x.as_py() or [], np.int64)).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, bytes binary")


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode every text, decode the ids again, and give digests of both:
    doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned 32-bit
    integers), decoded_sha256; on request the ids too. One pass."""
    def run(batches):
        table = ranks(path)
        for rows, data, offsets in T.blocks(batches):
            ids, first = encode_block(data, offsets, table)
            coded = memoryview(ids.astype("<u4").tobytes())
            sizes = table.token_at[ids + 1] - table.token_at[ids]
            back = memoryview(table.decode(ids).tobytes())
            byte_at = np.concatenate([[0], np.cumsum(sizes)])[first]
            texts = range(len(offsets) - 1)
            out = [
                rows.column(0), pa.array(np.diff(first)),
                pa.array([hashlib.sha256(coded[4 * first[i]: 4 * first[i + 1]]).hexdigest() for i in texts], pa.string()),
                pa.array([hashlib.sha256(back[byte_at[i]: byte_at[i + 1]]).hexdigest() for i in texts], pa.string()),
            ]
            if with_ids:
                out.append(pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(out)])

    return keyed_text(docs).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
