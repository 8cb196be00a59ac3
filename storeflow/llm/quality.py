"""Quality by nearest-neighbour voting over latent-semantic vectors.

1. Terms of a text are its words (A-Z lowered), the shapes of its tokens
   (runs of capitals, small letters, digits and of any other ASCII character
   become one sign each; other characters are left out) and repeats of the
   token before.
2. The learning fold has the labelled rows with crc32(doc_id as text) mod 5
   not 0, thinned by a hash of doc_id to about ``MAX_LABELLED`` rows. Of its
   terms those of two documents or more form the vocabulary, at most the
   ``MAX_TERMS`` most common ones. Document frequencies are counted over all
   documents.
3. A randomised singular value decomposition of the fold's TF-IDF rows gives
   ``RANK`` latent directions; vectors have unit length and whole-number
   entries (in steps of 2 ** -STEPS), so products are exact in any order.
4. The fold's vectors and labels are broadcast (at most MAX_LABELLED rows).
   Every document's cosine with every labelled vector is computed, block by
   block; the ``NEIGHBOURS`` nearest, and all that are as near as the last of
   them, vote with their cosine to the power ``POWER``. A labelled document
   votes on itself when it is in the fold.

The score is the neighbours' weighted share of label 1; a text without known
terms, or without a neighbour of positive cosine, gets the fold's share.

Null text counts as empty. Null labels and null doc_ids do not teach; of
repeated labels the largest counts, of repeated doc_ids the least text
teaches; rows that repeat a doc_id each give a row; a null doc_id is not held
out; very long texts are read whole; other columns are ignored. Without
learning rows every score is 0.5. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T
from .decontamination import Lookup
from .stages import Stage, keyed_text, stage
from .toxicity import held_out

#: Bounds on the rows that teach and vote, and on the terms that count.
MAX_LABELLED = 4096
MAX_TERMS = 1 << 15
RANK, SPARE, ROUNDS = 64, 8, 3
NEIGHBOURS, POWER = 25, 8
STEPS = 20
#: Weight of shapes and repeats, of which a text has few different ones.
SHAPE_WEIGHT = 4.0
LIKELY = 0.3

WORD, SHAPE = 0, 1
#: The term for a token that repeats the one before.
_AGAIN = np.uint64(0x5851F42D4C957F2D)

_SIGN = np.arange(256, dtype=np.uint8)
_SIGN[0x41:0x5B], _SIGN[0x61:0x7B], _SIGN[0x30:0x3A] = ord("A"), ord("a"), ord("0")


# ---- terms ------------------------------------------------------------------

def shapes(data: np.ndarray, t: T.Words) -> np.ndarray:
    """A hash of the shape of each token."""
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, t.starts, 1)
    token = np.cumsum(inside[:-1])
    ascii_at = np.flatnonzero(T.NOT_SPACE[data] & (data < 0x80))
    sign, token = _SIGN[data[ascii_at]], token[ascii_at]
    new = np.ones(len(sign), bool)
    new[1:] = (sign[1:] != sign[:-1]) | (token[1:] != token[:-1])
    sign, token = sign[new], token[new]
    return T.span_hashes(sign, np.searchsorted(token, np.arange(1, len(t.starts) + 1)), np.searchsorted(token, np.arange(1, len(t.starts) + 1), "right"), seed=5)


def text_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, term, kind) of all terms of a block."""
    w = T.words(T.lower(data), offsets, T.ALNUM)
    t = T.words(data, offsets, T.NOT_SPACE)
    h, owner = t.hashes(), t.owner()
    again = np.flatnonzero((h[1:] == h[:-1]) & (owner[1:] == owner[:-1])) + 1
    text = np.concatenate([w.owner(), owner, owner[again]])
    term = np.concatenate([w.hashes(), shapes(data, t), np.full(len(again), _AGAIN)])
    kind = np.concatenate([np.full(len(w.starts), WORD, np.int8), np.full(len(owner) + len(again), SHAPE, np.int8)])
    return text, term, kind


def _counted(text: np.ndarray, code: np.ndarray, codes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, code, times) of the distinct pairs, in order."""
    pair, times = np.unique(text * codes + code, return_counts=True)
    return pair // codes, pair % codes, times


def sample_terms(sample: DataFrame) -> DataFrame:
    """doc_id, quality and the distinct terms with kind and times of each labelled text."""
    def run(batches):
        for rows, data, offsets in T.blocks(batches):
            text, term, kind = text_terms(data, offsets)
            distinct, code = np.unique(term, return_inverse=True)
            kinds = np.zeros(len(distinct), np.int8)
            kinds[code] = kind
            text, code, times = _counted(text, code, max(len(distinct), 1))
            at = pa.array(np.searchsorted(text, np.arange(rows.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (T.signed(distinct[code]), kinds[code].astype(np.int32), times.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("quality"), *lists], names=["doc_id", "quality", "terms", "kinds", "times"])

    return sample.mapInArrow(run, "doc_id bigint, quality int, terms array<bigint>, kinds array<int>, times array<bigint>")


def document_frequencies(texts: DataFrame, terms) -> DataFrame:
    """(code, n): documents that have each of the vocabulary's terms (a
    broadcast, ascending); code -1 counts all documents."""
    def run(batches):
        look, n = Lookup(terms.value), np.zeros(len(terms.value) + 1, np.int64)
        for rows, data, offsets in T.blocks(batches):
            text, term, _ = text_terms(data, offsets)
            at, code = look.find(term)
            _, code, _ = _counted(text[at], code, len(n))
            n += np.bincount(code, minlength=len(n))
            n[-1] += rows.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(n) - 1), -1)), pa.array(n)], names=["code", "n"])

    return texts.mapInArrow(run, "code bigint, n bigint").where("n > 0").groupBy("code").agg(F.sum("n").alias("n"))


# ---- latent vectors ---------------------------------------------------------

@dataclass
class Model:
    terms: np.ndarray    # hashes, ascending
    weights: np.ndarray  # of the terms: inverse document frequency by kind
    basis: np.ndarray    # terms x RANK
    points: np.ndarray   # labelled vectors, whole numbers
    labels: np.ndarray
    share: float         # of label 1


def tf_idf(text: np.ndarray, times: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """Values of sparse rows of unit length, in order of ``text``."""
    x = (1 + np.log(times)) * weight
    length = np.sqrt(np.bincount(text, x * x, texts))
    return x / np.maximum(length[text], 1e-12)


def _sums(by: np.ndarray, size: int, column: np.ndarray, x: np.ndarray, dense: np.ndarray, most: int = 1 << 14) -> np.ndarray:
    """Per value of ``by`` (ascending) the sum of x times the rows of ``dense``
    named by ``column``; about ``most`` entries in memory at a time."""
    out = np.zeros((size, dense.shape[1]))
    at = np.searchsorted(by, np.arange(size + 1))
    lo = 0
    while lo < size:
        hi = max(int(np.searchsorted(at, at[lo] + most, "right")) - 1, lo + 1)
        a, b = at[lo], at[hi]
        full = np.flatnonzero(np.diff(at[lo: hi + 1])) + lo
        if len(full):
            out[full] = np.add.reduceat(dense[column[a:b]] * x[a:b, None], at[full] - a, axis=0)
        lo = hi
    return out


def latent_basis(text: np.ndarray, code: np.ndarray, x: np.ndarray, texts: int, terms: int, rank: int = RANK) -> np.ndarray:
    """The first right singular vectors (terms x rank) of sparse rows."""
    order = np.argsort(code, kind="stable")
    flipped = code[order], terms, text[order], x[order]
    rng = np.random.default_rng(11)
    y = rng.standard_normal((terms, min(rank + SPARE, terms, texts)))
    for _ in range(ROUNDS):
        y = np.linalg.qr(_sums(text, texts, code, x, y))[0]
        y = _sums(*flipped, y)
        y = np.linalg.qr(y)[0]
    _, _, turn = np.linalg.svd(_sums(text, texts, code, x, y), full_matrices=False)
    return y @ turn[:rank].T


def whole_numbers(v: np.ndarray) -> np.ndarray:
    """Rows of unit length in steps of 2 ** -STEPS (zero rows stay zero)."""
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.rint(v / np.where(length > 1e-9, length, np.inf) * (1 << STEPS))


def _fitted(weights):
    """The function that fits the one group of all labelled rows (few, see MAX_LABELLED)."""
    def fit(table: pa.Table) -> pa.Table:
        terms, weight = weights.value
        table = table.sort_by("doc_id").combine_chunks()
        n = table.num_rows
        lists = table.column("terms").combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        at, code = Lookup(terms).find(lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
        text = np.repeat(np.arange(n), size)[at]
        times = table.column("times").combine_chunks().flatten().to_numpy(zero_copy_only=False)[at]
        order = np.lexsort((code, text))
        text, code, times = text[order], code[order], times[order]
        x = tf_idf(text, times, weight[code], n)
        basis = latent_basis(text, code, x, n, len(terms))
        points = _sums(text, n, code, x, basis)
        rows = np.concatenate([basis, points])
        labels = np.concatenate([np.full(len(terms), -1), table.column("quality").to_numpy()])
        flat = pa.array(rows.ravel())
        return pa.table({"place": np.arange(len(rows)), "label": labels.astype(np.int32),
                         "vector": pa.ListArray.from_arrays(pa.array((np.arange(len(rows) + 1) * rows.shape[1]).astype(np.int32)), flat)})
    return fit


def learning(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, quality of the learning fold, at most about MAX_LABELLED rows."""
    known = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
                   .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.max("quality") > 0).cast("int").alias("quality")))
    n = known.count()
    if n > MAX_LABELLED:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * MAX_LABELLED / n))
    return keyed_text(docs).join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    spark = docs.sparkSession
    taught = Stage(sample_terms(Stage(learning(docs, labels), "labelled").df), "labelled-terms").df
    common = (taught.select(F.explode(F.arrays_zip("terms", "kinds")).alias("t")).select("t.terms", "t.kinds")
                    .groupBy("terms").agg(F.max("kinds").alias("kind"), F.count(F.lit(1)).alias("n")).where("n > 1")
                    .orderBy(F.desc("n"), "terms").limit(MAX_TERMS).toArrow())
    terms, kind = common["terms"].to_numpy().view(np.uint64), common["kind"].to_numpy()
    order = np.argsort(terms)
    terms, kind = terms[order], kind[order]
    quality = taught.agg(F.count(F.lit(1)).alias("n"), F.sum("quality").alias("good")).first()
    share = quality.good / quality.n if quality.n else 0.5
    if not len(terms):
        return Model(terms, np.zeros(0), np.zeros((0, RANK)), np.zeros((0, RANK)), np.zeros(0), share)
    met = document_frequencies(keyed_text(docs).select("text"), spark.sparkContext.broadcast(terms)).toArrow()
    code, n = met["code"].to_numpy(), met["n"].to_numpy()
    found = np.zeros(len(terms))
    found[code[code >= 0]] = n[code >= 0]
    weight = np.log((1 + n[code < 0].sum()) / (1 + found)) * np.where(kind == SHAPE, SHAPE_WEIGHT, 1.0)
    fitted = (taught.groupBy(F.lit(0).alias("all")).applyInArrow(_fitted(spark.sparkContext.broadcast((terms, weight))), "place bigint, label int, vector array<double>")
                    .toArrow().sort_by("place").combine_chunks())
    rows = fitted["vector"].combine_chunks().flatten().to_numpy().reshape(fitted.num_rows, -1)
    points = fitted["label"].to_numpy() >= 0
    return Model(terms, weight, rows[~points].astype(np.float32), whole_numbers(rows[points]), fitted["label"].to_numpy()[points].astype(float), share)


# ---- votes ------------------------------------------------------------------

def vectors(model: Model, look: Lookup, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The latent vector of each text of a block."""
    texts = len(offsets) - 1
    text, term, _ = text_terms(data, offsets)
    at, code = look.find(term)
    text, code, times = _counted(text[at], code, max(len(model.terms), 1))
    x = tf_idf(text, times, model.weights[code], texts)
    return whole_numbers(_sums(text, texts, code, x, model.basis))


def votes(model: Model, v: np.ndarray, rows: int = 128) -> np.ndarray:
    """The score of each vector."""
    out = np.full(len(v), model.share)
    known = np.flatnonzero(v.any(axis=1)) if len(model.points) else np.zeros(0, np.int64)
    last = max(len(model.points) - NEIGHBOURS, 0)
    for lo in range(0, len(known), rows):
        part = known[lo: lo + rows]
        cosine = v[part] @ model.points.T  # whole numbers below 2 ** 53
        least = np.partition(cosine, last, axis=1)[:, last]
        row, near = np.nonzero((cosine >= least[:, None]) & (cosine > 0))
        weight = (cosine[row, near] / (1 << 2 * STEPS)) ** POWER
        total = np.bincount(row, weight, len(part))
        good = np.bincount(row, weight * model.labels[near], len(part))
        out[part] = np.where(total > 0, good / np.where(total > 0, total, 1), model.share)
    return out


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        look = Lookup(model.value.terms)
        for rows, data, offsets in T.blocks(batches):
            score = votes(model.value, vectors(model.value, look, data, offsets))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    told = keyed_text(docs).mapInArrow(run, "doc_id bigint, score double")
    return told.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LIKELY).cast("int").alias("predicted"))
