"""Benchmark decontamination by a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item
is one window). A document contains a window only if it contains all of the
window's shingles of three words, so one of them, the rarest by its count
over all documents, is the necessary prefix: documents are joined on that
shingle alone. A join partner gives the window's only possible place (the
shingle's place less its offset: positional bound), which must lie inside
the document (length bound), and the words there are compared exactly.

The benchmark is the stated query set: it is taken in blocks of at most
``BLOCK_BYTES`` of text, whose index is broadcast; all documents pass every
block, however many there are. Documents are never shuffled.

Null text has no words (no hits, never contaminated); an item without words
has no window; a null item_id counts as the empty id; items that repeat an
id or a text count once per id; documents that repeat a doc_id each give a
row; extra columns are ignored (or kept, by ``clean``); an empty benchmark
leaves every document clean; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .byte_bpe import ragged
from .stages import Stage, keyed_text

WINDOW = 13
SHINGLE = 3
#: Benchmark text indexed and broadcast at a time.
BLOCK_BYTES = 4 << 20
#: A document is contaminated from one hit word in so many on.
HIT_SHARE = 20
_COMPARE = 1 << 16


class Lookup:
    """Sorted 64-bit keys with a bit filter before the search."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        size = 1 << min(26, max(16, int(64 * max(len(self.keys), 1)).bit_length()))
        self.mask = np.uint64(size - 1)
        self.filter = np.zeros(size, bool)
        self.filter[(self.keys & self.mask).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index in ``h``, index in ``keys``) of all matches."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.filter[(h & self.mask).astype(np.int64)])
        k = np.searchsorted(self.keys, h[at])
        k[k == len(self.keys)] = 0
        hit = self.keys[k] == h[at]
        return at[hit], k[hit]


class Shingled:
    """The words of a block of texts, and its shingles of a size."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = T.words(T.lower(data), offsets, T.ALNUM)
        self.h = self.words.hashes()

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, place of the first word) of all shingles inside a text."""
        h = T.window_hashes(self.h, size)
        inside = np.ones(len(h), bool)
        for back in range(1, size):  # none that runs over a text's last word
            cut = self.words.first[1:-1] - back
            inside[cut[(cut >= 0) & (cut < len(h))]] = False
        at = np.flatnonzero(inside)
        return h[at], at


def _runs(covered: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of covered words, cut at texts: (text, begin, end), the places
    counted from the text's first word."""
    n = len(covered)
    flag = np.zeros(n + 1, np.int8)
    flag[:n] = covered
    change = np.diff(flag, prepend=np.int8(0))
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    cuts = np.unique(first[1:-1])
    cuts = cuts[(cuts > 0) & (cuts < n)]
    cuts = cuts[covered[cuts] & covered[cuts - 1]]
    if len(cuts):
        begin, end = np.sort(np.append(begin, cuts)), np.sort(np.append(end, cuts))
    text = np.searchsorted(first, begin, "right") - 1
    return text, begin - first[text], end - first[text]


class Index:
    """Windows of a block of benchmark items, and their shingles."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        texts = pa.array([t for _, t in items], pa.string())
        s = Shingled(*T.text_buffer(texts))
        w = s.words
        self.bytes, starts, ends = T.joined_words(w)
        counts, first = w.counts, w.first[:-1]
        size = np.minimum(counts, window)
        n = np.where(counts > 0, counts - size + 1, 0)
        item = np.repeat(np.arange(len(items)), n)
        at = np.repeat(first, n) + ragged(np.zeros(len(n), np.int64), n)
        length = size[item]
        # equal windows are one, with all their items
        key: dict[bytes, int] = {}
        self.items: list[set[str]] = []
        chosen = []
        raw = self.bytes.tobytes()
        for k, (i, a, m) in enumerate(zip(item.tolist(), at.tolist(), length.tolist())):
            number = key.setdefault(raw[starts[a]: ends[a + m - 1]], len(key))
            if number == len(chosen):
                chosen.append(k)
                self.items.append(set())
            self.items[number].add(items[i][0])
        chosen = np.array(chosen, np.int64)
        self.at, self.length = at[chosen], length[chosen]
        self.byte_at = starts[self.at] if len(chosen) else np.zeros(0, np.int64)
        self.byte_n = ends[self.at + self.length - 1] - self.byte_at if len(chosen) else np.zeros(0, np.int64)
        self.size = np.minimum(self.length, SHINGLE)
        self._h = s.h
        self.all = {z: Lookup(self._window_shingles(z)[0]) for z in (1, 2, 3)}

    def _window_shingles(self, z: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, window, offset) of the shingles of the windows that take
        shingles of ``z`` words."""
        own = np.flatnonzero(self.size == z)
        n = self.length[own] - z + 1
        window = np.repeat(own, n)
        offset = ragged(np.zeros(len(n), np.int64), n)
        h = T.window_hashes(self._h, z)
        return (h[self.at[window] + offset] if len(window) else np.zeros(0, np.uint64)), window, offset

    def choose(self, counts: dict[int, int]) -> None:
        """Keep each window's rarest shingle (of equals the first)."""
        self.prefix = {}
        for z in (1, 2, 3):
            h, window, offset = self._window_shingles(z)
            n = np.array([counts.get(k, 0) for k in T.signed(h).tolist()], np.int64)
            order = np.lexsort((offset, n, window))
            order = order[np.unique(window[order], return_index=True)[1]] if len(order) else order
            h, window, offset = h[order], window[order], offset[order]
            by = np.argsort(h, kind="stable")
            h, window, offset = h[by], window[by], offset[by]
            look = Lookup(h)
            self.prefix[z] = look, np.searchsorted(h, look.keys, "left"), np.searchsorted(h, look.keys, "right"), window, offset
        del self._h, self.all

    def hits(self, s: Shingled) -> tuple[np.ndarray, np.ndarray]:
        """(first word, window) of all occurrences in a block of texts."""
        w = s.words
        joined, starts, ends = T.joined_words(w)
        found = []
        for z, (look, lo, hi, window, offset) in self.prefix.items():
            if not len(look.keys):
                continue
            h, place = s.shingles(z)
            at, k = look.find(h)
            n = hi[k] - lo[k]
            pick = ragged(lo[k], n)
            begin, win = np.repeat(place[at], n) - offset[pick], window[pick]
            text = np.repeat(np.searchsorted(w.first, place[at], "right") - 1, n)
            fits = (begin >= w.first[text]) & (begin + self.length[win] <= w.first[text + 1])
            begin, win = begin[fits], win[fits]
            for c in range(0, len(begin), _COMPARE):
                b, v = begin[c: c + _COMPARE], win[c: c + _COMPARE]
                same = ends[b + self.length[v] - 1] - starts[b] == self.byte_n[v]
                b, v = b[same], v[same]
                if not len(b):
                    continue
                size = self.byte_n[v]
                equal = joined[ragged(starts[b], size)] == self.bytes[ragged(self.byte_at[v], size)]
                same = np.logical_and.reduceat(equal, np.cumsum(size) - size)
                found.append((b[same], v[same]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([b for b, _ in found]), np.concatenate([v for _, v in found])


def _shingle_counts(docs: DataFrame, index) -> DataFrame:
    """(shingle, n): occurrences over all documents of the index's shingles."""
    def run(batches):
        for _, data, offsets in T.blocks(batches):
            s = Shingled(data, offsets)
            for z, look in index.value.all.items():
                if len(look.keys):
                    _, k = look.find(s.shingles(z)[0])
                    k, n = np.unique(k, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(T.signed(look.keys[k])), pa.array(n)], names=["shingle", "n"])

    return docs.select("text").mapInArrow(run, "shingle bigint, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))


def _matched(docs: DataFrame, index, last: bool) -> DataFrame:
    """One block's hits added to ``runs`` (covered words as begin, end, begin,
    end ...) and ``items`` of every row."""
    def run(batches):
        for rows, data, offsets in T.blocks(batches):
            s = Shingled(data, offsets)
            w = s.words
            begin, win = index.value.hits(s)
            step = np.zeros(len(s.h) + 1, np.int64)
            np.add.at(step, begin, 1)
            np.add.at(step, begin + index.value.length[win], -1)
            n = len(offsets) - 1
            for i, old in enumerate(rows.column("runs").to_pylist()):
                for a, b in zip(old[::2], old[1::2]):
                    step[w.first[i] + a] += 1
                    step[w.first[i] + b] -= 1
            text, a, b = _runs(np.cumsum(step[:-1]) > 0, w.first)
            items = [set(x) for x in rows.column("items").to_pylist()]
            owner = np.searchsorted(w.first, begin, "right") - 1
            for pair in np.unique(owner * max(len(index.value.items), 1) + win).tolist():
                i, v = divmod(pair, len(index.value.items))
                items[i] |= index.value.items[v]
            at = np.searchsorted(text, np.arange(n + 1)).astype(np.int32) * 2
            runs = pa.ListArray.from_arrays(pa.array(at), pa.array(np.stack([a, b], 1).ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.nulls(n, pa.string()) if last else rows.column("text"), pa.array(w.counts),
                 runs, pa.array([sorted(x) for x in items], pa.list_(pa.string()))],
                names=["doc_id", "text", "n_words", "runs", "items"])

    return docs.mapInArrow(run, "doc_id bigint, text string, n_words bigint, runs array<int>, items array<string>")


def overlap(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For every document: doc_id, n_words, runs (covered words as begin, end
    pairs), items (ids of the items that have a window in it, as strings)."""
    spark = docs.sparkSession
    docs = keyed_text(docs)
    items = Stage(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"),
                                   F.coalesce("text", F.lit("")).alias("text")).distinct(), "items").df
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-total // block_bytes))
    out = docs.select("doc_id", "text", F.lit(0).cast("bigint").alias("n_words"),
                      F.array().cast("array<int>").alias("runs"), F.array().cast("array<string>").alias("items"))
    for k in range(n_blocks):
        part = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k)
        index = Index([(r.item, r.text) for r in part.collect()], window)
        shared = spark.sparkContext.broadcast(index)
        counts = {r.shingle: r.n for r in _shingle_counts(docs, shared).collect()}
        index.choose(counts)
        out = _matched(out, spark.sparkContext.broadcast(index), last=k == n_blocks - 1)
    return out.drop("text")


def judged(found: DataFrame, share: int = HIT_SHARE) -> DataFrame:
    """``overlap`` with the number of hit words and items, and the verdict."""
    hit = F.aggregate(F.transform("runs", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)),
                      F.lit(0).cast("bigint"), lambda a, x: a + x)
    return (found.withColumn("n_hit", hit)
                 .withColumn("n_items", F.size("items").cast("bigint"))
                 .withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: int = HIT_SHARE) -> DataFrame:
    """The documents that are not contaminated, all columns kept. A doc_id
    with a contaminated row goes with all its rows; a null doc_id stays."""
    bad = judged(overlap(docs, benchmark, window), share).where("contaminated").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
