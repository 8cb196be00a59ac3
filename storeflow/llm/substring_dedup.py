"""Substring dedup by recompression.

A window is ``WINDOW`` consecutive words. A word goes if it is covered by a
window whose words also start in a document with a smaller doc_id.

Shuffling every window would move several times the text. Recompression
names ever longer parts of the text alike wherever they occur: the first
round names runs of an equal word; in each later round a symbol is left or
right by a bit of its name, and a left symbol followed by a right one
becomes one symbol named after the pair. Names are 64-bit hashes of what
they stand for, so they agree over all documents. Of the symbols inside a
window, those whose making depends on the window's words alone (the first
run and, in a pair round, a leading right or a trailing left symbol do not)
are the same in every occurrence of the window. The window's sign is the
longest of its symbols after ``ROUNDS`` pair rounds (of equals the least
name), or of its last round that had any; a window without one (a single
repeated word) is its own sign.

1. Signs are few (neighbouring windows share them). Spark groups them and
   keeps those met in two documents or more.
2. Documents meet their shared signs; only windows under a shared sign stay
   candidates, the rest of the text is done.
3. Candidate windows are verified: grouped by 96 bits of two independent
   hashes of their words, the least doc_id of each found, and the words of windows
   that an earlier document has are removed.

Null text counts as empty (no words); a null doc_id is smaller than none
and nothing is smaller than it, so its text stays; rows that repeat a
doc_id are judged alike and each give a row; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .byte_bpe import ragged
from .decontamination import _runs
from .stages import Stage, keyed_text, release

WINDOW = 13
#: Pair rounds. More rounds make longer symbols but leave fewer of them in a
#: window, and windows share a sign less often.
ROUNDS = 3
_NAME = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def window_starts(w: T.Words, size: int) -> np.ndarray:
    """First words of all windows that lie inside a text."""
    n = np.maximum(w.counts - size + 1, 0)
    return ragged(w.first[:-1], n)


def name_runs(h: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(name of each run of an equal word, run of each word). ``begins`` marks
    the first word of each text."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | begins[1:]
    run = np.cumsum(new) - 1
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(h))).astype(np.uint64)
    return T.mix(h[at] + size * _NAME[0]), run


def name_pairs(name: np.ndarray, joined: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One pair round: (names, place of each symbol in the new sequence, which
    symbols are right). ``joined``: whether a symbol follows in the same text."""
    side = T.mix(name + np.uint64(level) * _NAME[2])
    right = (side & np.uint64(1)).astype(bool)
    pair = ~right[:-1] & right[1:] & joined[:-1]
    second = np.zeros(len(name), bool)
    second[1:] = pair
    place = np.cumsum(~second) - 1
    made = name.copy()
    made[:-1][pair] = T.mix(name[:-1][pair] * _NAME[0] + name[1:][pair] * _NAME[1] + np.uint64(level))
    return made[~second], place, right


def _least_between(value: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Least value of each range low .. high - 1 (none is empty)."""
    least = value[low]
    for step in range(1, int((high - low).max()) if len(low) else 0):
        np.minimum(least, value[np.minimum(low + step, high - 1)], out=least)
    return least


def signs(w: T.Words, h: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(first word, sign) of all windows of a block of texts."""
    start = window_starts(w, size)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    sign = T.window_hashes(h, size)[start]
    begins = np.zeros(len(h) + 1, bool)
    begins[w.first] = True
    name, run = name_runs(h, begins[:-1])
    # symbols low .. high - 1 of a round depend on the window alone
    low, high = run[start] + 1, run[start + size - 1]
    live = np.flatnonzero(low < high)
    low, high = low[live], high[live]
    first_run = np.zeros(len(name), bool)
    first_run[run[np.flatnonzero(begins[:-1])]] = True
    joined = np.append(~first_run[1:], False)
    words = np.ones(len(name), np.int64)
    for level in range(1, ROUNDS + 1):
        new, place, right = name_pairs(name, joined, level)
        a, b = low + right[low], high - ~right[high - 1]
        last = a >= b  # the highest round of these windows
        sign[live[last]] = _least_between(_ranked(name, words), low[last], high[last])
        go = ~last
        live, low, high = live[go], place[a[go]], place[b[go] - 1] + 1
        still = np.zeros(len(new), bool)
        still[place] = joined  # of a pair, the second symbol is written last
        name, joined, words = new, still, np.bincount(place, words, len(new)).astype(np.int64)
    sign[live] = _least_between(_ranked(name, words), low, high)
    return start, sign


def _ranked(name: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Symbols in the order in which they are chosen as signs: longer ones
    first, as fewer texts share them."""
    return (name >> np.uint64(4)) | ((15 - np.minimum(words, 15)).astype(np.uint64) << np.uint64(60))


def _second_hashes(w: T.Words, size: int) -> np.ndarray:
    return T.window_hashes(w.hashes(seed=1), size, seed=7)


def _block(data, offsets):
    w = T.words(data, offsets, T.NOT_SPACE)
    return w, w.hashes()


def _distinct(text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Places of one occurrence of each (text, key)."""
    return np.unique(T.mix(key + text.astype(np.uint64) * _NAME[2]), return_index=True)[1]


def document_signs(texts: DataFrame, size: int) -> DataFrame:
    """(sign, doc_id), once per text."""
    def run(batches):
        for rows, data, offsets in T.blocks(batches):
            w, h = _block(data, offsets)
            start, sign = signs(w, h, size)
            text = np.searchsorted(w.first, start, "right") - 1
            change = np.ones(len(sign), bool)
            change[1:] = (sign[1:] != sign[:-1]) | (text[1:] != text[:-1])
            sign, text = sign[change], text[change]
            one = np.sort(_distinct(text, sign))
            yield pa.RecordBatch.from_arrays([pa.array(T.signed(sign[one])), rows.column(0).take(pa.array(text[one]))],
                                             names=["sign", "doc_id"])

    return texts.where("doc_id is not null").mapInArrow(run, "sign bigint, doc_id bigint")


def _digest(w: T.Words, keep: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(words kept, SHA-256 of the kept words joined by a space) per text."""
    joined, starts, ends = T.joined_words(w)
    kept = T.Words(joined, starts[keep], ends[keep], np.concatenate([[0], np.cumsum(keep)])[w.first])
    raw, starts, ends = T.joined_words(kept)
    raw = memoryview(raw.tobytes())
    first = kept.first.tolist()
    return kept.counts, [hashlib.sha256(raw[starts[a]: ends[b - 1]] if b > a else b"").hexdigest() for a, b in zip(first, first[1:])]


_CANDIDATES = "doc_id bigint, n_words bigint, kept_sha256 string, text string, runs array<int>"


def _candidates(met: DataFrame, size: int) -> DataFrame:
    """Texts and their shared signs to done rows (text null) and rows with
    the runs of first words of their candidate windows."""
    def run(batches):
        for rows, data, offsets in T.blocks(batches):
            w, h = _block(data, offsets)
            start, sign = signs(w, h, size)
            lists = rows.column("signs")
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            own = np.repeat(np.arange(len(n)), n)
            key = T.mix(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) + own.astype(np.uint64) * _NAME[2])
            text = np.searchsorted(w.first, start, "right") - 1
            mine = T.mix(sign + text.astype(np.uint64) * _NAME[2])
            shared = np.isin(mine, key)
            covered = np.zeros(len(h), bool)
            covered[start[shared]] = True
            text, a, b = _runs(covered, w.first)
            at = np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32)
            done = np.diff(at) == 0
            counts, sha = _digest(w, np.ones(len(h), bool))
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), pa.array(counts),
                pa.array([x if d else None for x, d in zip(sha, done.tolist())], pa.string()),
                pa.array([None if d else t for t, d in zip(rows.column("text").to_pylist(), done.tolist())], pa.string()),
                pa.ListArray.from_arrays(pa.array(2 * at), pa.array(np.stack([a, b], 1).ravel().astype(np.int32))),
            ], names=["doc_id", "n_words", "kept_sha256", "text", "runs"])

    return met.mapInArrow(run, _CANDIDATES)


def _run_starts(rows: pa.RecordBatch, w: T.Words) -> np.ndarray:
    """First words of the candidate windows of a block."""
    lists = rows.column("runs")
    n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) // 2
    ab = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2)
    return ragged(ab[:, 0] + np.repeat(w.first[:-1], n), ab[:, 1] - ab[:, 0])


def _windows(rows: DataFrame, size: int) -> DataFrame:
    """(w1, w2, doc_id) of the candidate windows, once per text: 96 bits of
    two independent hashes stand for the words."""
    def run(batches):
        for rows, data, offsets in T.blocks(batches):
            w, h = _block(data, offsets)
            start = _run_starts(rows, w)
            one, two = T.window_hashes(h, size)[start], _second_hashes(w, size)[start]
            text = np.searchsorted(w.first, start, "right") - 1
            pick = np.sort(_distinct(text, one))
            yield pa.RecordBatch.from_arrays(
                [pa.array(T.signed(one[pick])), pa.array((two[pick] >> np.uint64(32)).astype(np.uint32).view(np.int32)), rows.column("doc_id").take(pa.array(text[pick]))],
                names=["w1", "w2", "doc_id"])

    return rows.select("doc_id", "text", "runs").mapInArrow(run, "w1 bigint, w2 int, doc_id bigint")


def _cut(rows: DataFrame, size: int) -> DataFrame:
    """Remove the words of repeated windows (hashes in ``repeats``)."""
    def run(batches):
        for rows, data, offsets in T.blocks(batches):
            w, h = _block(data, offsets)
            start = _run_starts(rows, w)
            text = np.searchsorted(w.first, start, "right") - 1
            lists = rows.column("repeats")
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            own = np.repeat(np.arange(len(n)), n)
            key = T.mix(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64) + own.astype(np.uint64) * _NAME[2])
            mine = T.mix(T.window_hashes(h, size)[start] + text.astype(np.uint64) * _NAME[2])
            start = start[np.isin(mine, key)]
            step = np.zeros(len(h) + 1, np.int64)
            np.add.at(step, start, 1)
            np.add.at(step, start + size, -1)
            keep = np.cumsum(step[:-1]) == 0
            kept, sha = _digest(w, keep)
            text, a, b = _runs(~keep, w.first)
            at = np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32) * 2
            gone = pa.ListArray.from_arrays(pa.array(at), pa.array(np.stack([a, b], 1).ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(w.counts), pa.array(w.counts - kept), pa.array(sha, pa.string()), gone],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"])

    return rows.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, removed array<int>")


def repeated(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and ``removed``: the runs of
    removed words as begin, end, begin, end ..."""
    spark = docs.sparkSession
    texts = keyed_text(docs)
    # stages are written and shuffle files released one after the other, so
    # that no more than one round of them takes up disk
    told = Stage(document_signs(texts, size), "signs")
    shared = Stage(told.df.groupBy("sign").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("sign"), "shared-signs")
    release(spark)
    lists = Stage(told.df.join(shared.df, "sign").groupBy("doc_id").agg(F.collect_list("sign").alias("signs")), "sign-lists")
    told.drop()
    shared.drop()
    release(spark)
    rows = Stage(_candidates(texts.join(lists.df, "doc_id", "left"), size), "candidates")
    lists.drop()
    release(spark)
    open_rows = rows.df.where("text is not null")
    first = Stage(_windows(open_rows, size).groupBy("w1", "w2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
                  .where("a < b").select("w1", "w2", "a"), "repeated-windows")
    release(spark)
    repeats = Stage(_windows(open_rows, size).join(first.df, ["w1", "w2"]).where("doc_id > a")
                    .groupBy("doc_id").agg(F.collect_list("w1").alias("repeats")), "repeats").df
    first.drop()
    release(spark)
    cut = _cut(open_rows.join(repeats, "doc_id", "left").select("doc_id", "text", "runs", "repeats"), size)
    done = rows.df.where("text is null").select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), "kept_sha256",
                                                F.array().cast("array<int>").alias("removed"))
    return done.unionByName(cut)
