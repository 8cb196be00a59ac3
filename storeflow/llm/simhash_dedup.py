"""SimHash near-duplicates with Golay-code fuzzy keys.

Fingerprints of 64 bits link at ``MAX_BITS`` (2) or fewer differing bits.
Each fingerprint is cut into segments of 23, 23 and 18 bits. The perfect
(23, 12) Golay code decodes every 23-bit word within three errors of one
codeword, and the codewords of a segment and of its 23 neighbours at one
flipped bit are 1 or 6 codeword indices; two segments with at most two
differing bits always have an index in common (the word halfway between
them decodes to one codeword). By the pigeonhole principle, of two errors
over three segments either the last segment is whole, or one of the first
two is whole and the other has at most one error, so the keys

    (last segment, index of first), (first segment, index of second),
    (second segment, index of first)

meet for every linked pair. Candidates are verified on the whole 64 bits.

Nulls in text count as empty text; empty text has fingerprint zero, linked
like any other; extra columns are ignored; an empty table gives an empty
result; repeated texts have one fingerprint, and rows that repeat a doc_id
each give a row. A null doc_id is given back with its fingerprint, takes no
part in naming components and gets the least doc_id of its fingerprint's
component.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .graph import components
from .stages import keyed_text, stage

SHINGLE = 3
MAX_BITS = 2
SEGMENTS = (23, 23, 18)
#: Buckets up to this many distinct fingerprints are compared pair by pair;
#: members of larger ones meet on shared neighbours instead (exact too).
PAIRWISE = 32

_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_SPREAD = np.uint64(0x0101010101010101)


# ---- fingerprints ---------------------------------------------------------

def shingle_hashes(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 (seed 42) of every shingle of a block of texts, and the number
    of shingles of each text. A shingle is ``size`` words joined by a space;
    a text with fewer words has one shingle of all of them, none without words."""
    w = T.words(T.lower(data), offsets, T.NOT_SPACE)
    joined, starts, ends = T.joined_words(w)
    counts = w.counts
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.repeat(w.first[:-1] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    last = np.minimum(first + size, np.repeat(w.first[1:], n)) - 1
    buffer, digest = joined.tobytes(), xxhash.xxh64_intdigest
    spans = zip(starts[first].tolist(), ends[last].tolist())
    return np.fromiter((digest(buffer[a:b], 42) for a, b in spans), np.uint64, len(first)), n


def majority_bits(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per text (``n`` hashes each), the bits set in over half its hashes.
    Bits are counted eight at a time in the byte lanes of a word, over runs
    of at most 255 hashes, so no lane overflows."""
    out = np.zeros(len(n), np.uint64)
    full = np.flatnonzero(n)
    if not len(full):
        return out
    counts = n[full]
    begin = np.cumsum(counts) - counts
    runs = -(-counts // 255)
    run_text = np.repeat(np.arange(len(full)), runs)
    run_begin = begin[run_text] + 255 * (np.arange(len(run_text)) - np.repeat(np.cumsum(runs) - runs, runs))
    text_run = np.cumsum(runs) - runs
    for bit in range(8):
        lanes = np.add.reduceat((h >> np.uint64(bit)) & _SPREAD, run_begin)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), text_run, axis=0)
        set_bits = (2 * sums > counts[:, None]).astype(np.uint8)  # little endian: lane k is byte k
        out[full] |= np.ascontiguousarray(set_bits).view(np.uint64).ravel() << np.uint64(bit)
    return out


def fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each text as a signed long."""
    def run(batches):
        for rows, data, offsets in T.blocks(batches):
            h, n = shingle_hashes(data, offsets, size)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(T.signed(majority_bits(h, n)))], names=["doc_id", "fp"])

    return keyed_text(docs).mapInArrow(run, "doc_id bigint, fp bigint")


# ---- Golay keys -----------------------------------------------------------

def _syndromes(v: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit polynomial by the code's generator."""
    r = v.astype(np.int64)
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (_GENERATOR << (bit - 11)), r)
    return r


def _errors() -> np.ndarray:
    """For each of the 2048 syndromes, its one error pattern of weight <= 3."""
    one = [0] + [1 << i for i in range(23)]
    patterns = np.unique([a ^ b ^ c for a in one for b in one for c in one])
    table = np.zeros(2048, np.int64)
    table[_syndromes(patterns)] = patterns
    return table


_ERRORS = _errors()


def codeword_index(v: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the codeword nearest to each 23-bit word."""
    return (v ^ _ERRORS[_syndromes(v)]) >> 11


def near_indices(v: np.ndarray) -> np.ndarray:
    """Codeword indices of each word and its 23 one-bit neighbours, sorted;
    repeats are -1. One column per neighbour."""
    flips = np.array([0] + [1 << i for i in range(23)])
    found = np.sort(codeword_index(v[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def fuzzy_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for all keys of each fingerprint."""
    u = fp.view(np.uint64)
    a = (u & np.uint64((1 << 23) - 1)).astype(np.int64)
    b = (u >> np.uint64(23) & np.uint64((1 << 23) - 1)).astype(np.int64)
    c = (u >> np.uint64(46)).astype(np.int64)
    rows, keys = [], []
    index_a, index_b = near_indices(a), near_indices(b)
    for tag, (exact, index) in enumerate(((c, index_a), (a, index_b), (b, index_a))):
        r, col = np.nonzero(index >= 0)
        rows.append(r)
        keys.append((tag << 36) | (exact[r] << 12) | index[r, col])
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(prints: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for lo in range(0, len(fp), 1 << 14):
                part = fp[lo: lo + (1 << 14)]
                row, key = fuzzy_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])

    return prints.select("fp").mapInArrow(run, "key bigint, fp bigint")


# ---- links and groups -----------------------------------------------------

def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those
    of all pairs at ``max_bits`` or fewer differing bits (at most 2, which
    the keys are made for). Small buckets give their linked pairs. A
    fingerprint of a larger bucket meets the others on its 65 neighbours
    within one bit: two fingerprints within two bits, and only those, share
    such a neighbour, so each needs one edge to the least on it."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the keys are made for 0 to 2 differing bits")
    keyed = stage(_keyed(prints), "fuzzy-keys")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = stage(keyed.join(sizes, "key"), "fuzzy-buckets")
    small = member.where(F.col("n") <= PAIRWISE)
    pairs = (small.groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps"))
                  .select(F.posexplode("fps").alias("i", "a"), "fps")
                  .select("a", F.explode(F.slice("fps", F.col("i") + 2, F.lit(PAIRWISE))).alias("b"))
                  .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
                  .distinct())
    crowded = member.where(F.col("n") > PAIRWISE).select("fp").distinct()
    balls = crowded.select("fp", F.explode(_neighbours()).alias("point"))
    if max_bits == 2:
        least = balls.groupBy("point").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
        stars = balls.join(least, "point").select(F.col("fp").alias("a"), "b").where("a <> b")
    else:  # one bit: the neighbour itself; none: distinct fingerprints never link
        reach = balls if max_bits else balls.where("fp = point")
        stars = (reach.join(crowded.withColumnRenamed("fp", "b"), F.col("point") == F.col("b"))
                      .select(F.col("fp").alias("a"), "b").where("a < b"))
    return pairs.unionByName(stars)


def _neighbours():
    flips = [1 << i for i in range(63)] + [-(1 << 63)]
    return F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(x).cast("bigint")) for x in flips])


def near_duplicates(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (least doc_id that
    links reach) for every row of ``docs``."""
    prints = stage(fingerprints(docs, size), "fingerprints")
    heads = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("head")), "fingerprint-heads")
    edges = stage(links(heads.where("head is not null"), max_bits), "links")
    named = (edges.join(heads.select(F.col("fp").alias("a"), F.col("head").alias("ha")), "a")
                  .join(heads.select(F.col("fp").alias("b"), F.col("head").alias("hb")), "b")
                  .select(F.col("ha").alias("a"), F.col("hb").alias("b")))
    group = components(named)
    classes = (heads.join(group, F.col("head") == F.col("node"), "left")
                    .select("fp", F.coalesce("component", "head").alias("component_id")))
    return (prints.join(classes, "fp")
                  .select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"))


def clean(docs: DataFrame, size: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One document of each group stays, the one with the least doc_id; all
    columns are kept. A null doc_id stays; rows that repeat a doc_id stay or
    go together."""
    gone = (near_duplicates(docs, size, max_bits).where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
