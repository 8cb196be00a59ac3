"""Toxicity by maximum-scoring segments.

1. Words (by their 64-bit hash) are counted over all documents, and over
   the toxic and the other labelled documents of the learning fold.
2. A word's score is its log-odds between the two classes under a Dirichlet
   prior shaped like the whole corpus, drawn towards zero by ``CERTAINTY``
   standard deviations (words whose odds are no surer than that score zero,
   as do words that no labelled document has),
   less a drift per word, so that ordinary text scores below zero.
3. A linear-time scan finds every maximal-scoring segment of a text.
4. Segment scores of length-n text without toxic passages follow an extreme-
   value law, P(best <= x) = exp(-K n exp(-lambda x)): lambda solves
   E exp(lambda s) = 1 over the corpus's words, K is the maximum-likelihood
   value over the learning fold's non-toxic documents. A passage's evidence
   is lambda x - ln(K n), its surprise beyond chance in a text so long; the
   significant ones (above 0) add up to the text's evidence.
5. A logistic curve over the evidence, fitted on the learning fold, gives a
   score from 0 to 1.

The learning fold has the labelled rows with crc32(doc_id as text) mod 5
not 0; it is thinned by a hash of doc_id to about ``MAX_LABELLED`` rows when
there are more (so it can be broadcast). Corpus counts cover all documents.

Null text counts as empty text: no evidence, the lowest score. Null labels
and null doc_ids do not teach; of repeated labels the largest counts; rows
that repeat a doc_id each give a row; a null doc_id is not held out; extra
columns are ignored (or kept, by ``clean``). Without labels of both classes
every score is 0. An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .decontamination import Lookup
from .stages import Stage, keyed_text, stage

#: Distinct words that a task adds up before it hands them on.
WORDS_HELD = 1 << 20
#: Bound on the labelled rows that teach.
MAX_LABELLED = 500_000
#: Words of prior, as a share of the smaller class's words.
PRIOR = 0.05
CERTAINTY = 2.0
DRIFT = 0.2
FOLDS = 5
#: Evidence is told apart in steps of 1 / EVIDENCE_STEPS up to MOST_EVIDENCE
#: when the curve is fitted.
EVIDENCE_STEPS, MOST_EVIDENCE = 4, 200.0


@dataclass
class Model:
    words: np.ndarray   # hashes of the words that score, ascending
    scores: np.ndarray  # of these words; all others score -DRIFT
    rate: float         # lambda
    k: float = 1.0
    base: float = -40.0  # logistic curve: base + slope * evidence
    slope: float = 0.0


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def teaching(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the learning fold, at most about MAX_LABELLED rows."""
    known = (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
                   .groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")))
    n = known.count()
    if n > MAX_LABELLED:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * MAX_LABELLED / n))
    return known


def hashed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, T.Words]:
    w = T.words(T.lower(data), offsets, T.ALNUM)
    return w.hashes(), w


def _added(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words, and the sums of their rows of counts."""
    order = np.argsort(words, kind="stable")
    words, counts = words[order], counts[order]
    first = np.flatnonzero(np.diff(words, prepend=~words[:1]) != 0)
    return (words[first], np.add.reduceat(counts, first)) if len(first) else (words, counts)


def word_counts(docs: DataFrame, taught: DataFrame) -> DataFrame:
    """(word, n, n_toxic, n_other) over all documents; each task adds its
    words up before the shuffle, WORDS_HELD distinct ones at a time."""
    def rows_of(words, counts):
        for part in np.array_split(np.arange(len(words)), max(1, len(words) // 65536)):
            yield pa.RecordBatch.from_arrays([pa.array(T.signed(words[part])), *(pa.array(counts[part, k]) for k in range(3))],
                                             names=["word", "n", "n_toxic", "n_other"])

    def run(batches):
        words, total = np.zeros(0, np.uint64), np.zeros((0, 3), np.int64)
        for rows, data, offsets in T.blocks(batches):
            h, w = hashed(data, offsets)
            label = np.repeat(rows.column("toxic").fill_null(-1).to_numpy(zero_copy_only=False), w.counts)
            new, counts = _added(h, np.stack([np.ones(len(h), np.int64), label == 1, label == 0], axis=1).astype(np.int64))
            words, total = _added(np.concatenate([words, new]), np.concatenate([total, counts]))
            if len(words) > WORDS_HELD:
                yield from rows_of(words, total)
                words, total = words[:0], total[:0]
        yield from rows_of(words, total)

    joined = docs.join(F.broadcast(taught), "doc_id", "left").select("text", "toxic")
    return (joined.mapInArrow(run, "word bigint, n bigint, n_toxic bigint, n_other bigint")
                  .groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "n_toxic", "n_other")]))


def log_odds(n: np.ndarray, toxic: np.ndarray, other: np.ndarray, n_words: int, n_distinct: int) -> np.ndarray:
    """Per word met in labelled documents: log-odds ratio under the prior
    shaped like the corpus of ``n_words`` words, ``n_distinct`` of them
    distinct, drawn to zero by CERTAINTY standard deviations."""
    mass = PRIOR * max(min(toxic.sum(), other.sum()), 1)
    prior = mass * (n + 0.5) / (n_words + 0.5 * n_distinct)
    a, b = toxic + prior, other + prior
    ratio = np.log(a / (toxic.sum() + mass - a)) - np.log(b / (other.sum() + mass - b))
    sure = np.abs(ratio) - CERTAINTY * np.sqrt(1 / a + 1 / b)
    return np.sign(ratio) * np.maximum(sure, 0)


def decay_rate(scores: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of E exp(rate * s) = 1 (by bisection); the scores'
    mean is below zero and some score is above."""
    p = weights / weights.sum()
    s, where = np.unique(scores, return_inverse=True)
    p = np.bincount(where, p)
    s, p = s[p > 0], p[p > 0]
    if s.max() <= 0 or (s * p).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    while (p * np.exp(np.minimum(high * s, 700))).sum() < 1:
        low, high = high, high * 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 700))).sum() < 1 else (low, mid)
    return max(low, 1e-3)


def maximal_segments(scores) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score) of a sequence, left
    to right, in linear time: each open candidate keeps a link to the nearest
    earlier one whose running sum before it was lower."""
    found: list[list] = []  # begin, end, sum before, sum after, link
    total = 0.0
    for k, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        begin, low = k, before
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= total:
                break
            begin, low = found[j][0], found[j][2]  # both are one segment
            link = found[j][4]
            del found[j:]
            j = link
        found.append([begin, k + 1, low, total, j])
    return [(b, e, after - low) for b, e, low, after, _ in found]


def _text_segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """Maximal segments of one text's word scores; runs of words of one sign
    stay together, so only run sums are scanned."""
    sign = s > 0
    edges = np.flatnonzero(np.diff(sign)) + 1
    at = np.concatenate([[0], edges])
    ends = np.append(edges, len(s))
    return [(int(at[b]), int(ends[e - 1]), x) for b, e, x in maximal_segments(np.add.reduceat(s, at).tolist())]


def passages(docs: DataFrame, model) -> DataFrame:
    """doc_id, n_words and ``segments`` (begin, end, score), all maximal-
    scoring segments of every text. ``model``: a broadcast Model."""
    def run(batches):
        look, scores = Lookup(model.value.words), model.value.scores
        for rows, data, offsets in T.blocks(batches):
            h, w = hashed(data, offsets)
            s = np.full(len(h), -DRIFT)
            at, k = look.find(h)
            s[at] = scores[k]
            some = np.zeros(len(offsets) - 1, bool)
            some[np.unique(w.owner()[s > 0])] = True
            segments = [_text_segments(s[w.first[i]: w.first[i + 1]]) if some[i] else [] for i in range(len(some))]
            at = np.concatenate([[0], np.cumsum([len(x) for x in segments])]).astype(np.int32)
            flat = [x for y in segments for x in y]
            kind = pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
            values = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], kind.field(k).type) for k in range(3)], fields=list(kind))
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(w.counts), pa.ListArray.from_arrays(pa.array(at), values)],
                                             names=["doc_id", "n_words", "segments"])

    return docs.mapInArrow(run, "doc_id bigint, n_words bigint, segments array<struct<begin:int,end:int,score:double>>")


def evidence(model: Model) -> Column:
    """Sum of the significant passages' surprise."""
    chance = F.log(F.greatest(F.col("n_words") * F.lit(float(model.k)), F.lit(1.0)))
    return F.aggregate("segments", F.lit(0.0),
                       lambda a, x: a + F.greatest(x["score"] * F.lit(float(model.rate)) - chance, F.lit(0.0)))


def _fit_curve(x: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Logistic curve through counts at evidence x, slope at least 0."""
    a, b = 0.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -40, 40)))
        w = np.maximum(n * p * (1 - p), 1e-9)
        g = np.array([(toxic - n * p).sum(), ((toxic - n * p) * x).sum() - 1e-3 * b])
        h = np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(max(b, 0.0))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, DataFrame]:
    """The model, and ``passages`` of all documents by its word scores."""
    spark = docs.sparkSession
    texts = keyed_text(docs)
    taught = stage(teaching(labels), "labels")
    counted = Stage(word_counts(texts, taught), "words").df
    all_words = counted.agg(F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    # words of the bounded sample only
    found = counted.where("n_toxic + n_other > 0").toArrow()
    words = found["word"].to_numpy().view(np.uint64)
    n, toxic, other = (found[c].to_numpy().astype(float) for c in ("n", "n_toxic", "n_other"))
    del found
    if len(words) and toxic.sum() and other.sum():
        scores = log_odds(n, toxic, other, all_words.n, all_words.distinct)
        rate = decay_rate(np.append(scores, 0.0) - DRIFT, np.append(n, all_words.n - n.sum()))
        some = np.flatnonzero(scores)
        some = some[np.argsort(words[some])]
        model = Model(words[some], scores[some] - DRIFT, rate)
    else:
        model = Model(np.zeros(0, np.uint64), np.zeros(0), 1.0)
    rows = Stage(passages(texts, spark.sparkContext.broadcast(model)), "passages").df
    known = rows.join(F.broadcast(taught), "doc_id").where("n_words > 0")
    best = F.coalesce(F.array_max(F.transform("segments", lambda x: x["score"])), F.lit(0.0))
    r = known.where("toxic = 0").agg(F.sum((best > 0).cast("bigint")).alias("d"),
                                     F.sum(F.col("n_words") * F.exp(-F.lit(float(model.rate)) * best)).alias("s")).first()
    if r.d and r.s:
        model.k = r.d / r.s
    step = F.round(F.least(evidence(model), F.lit(MOST_EVIDENCE)) * EVIDENCE_STEPS)
    curve = known.groupBy(step.alias("step")).agg(F.sum("toxic").alias("toxic"), F.count(F.lit(1)).alias("n")).toArrow()
    x, toxic, total = (curve[c].to_numpy().astype(float) for c in ("step", "toxic", "n"))
    if 0 < toxic.sum() < total.sum():
        model.base, model.slope = _fit_curve(x / EVIDENCE_STEPS, toxic, total)
    return model, rows


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, n_words, segments of every row."""
    model, rows = fit(docs, labels)
    x = F.least(evidence(model), F.lit(MOST_EVIDENCE)) * model.slope + model.base
    return (rows.withColumn("score", 1 / (1 + F.exp(-x)))
                .select("doc_id", held_out().alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_words", "segments"))


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, all columns kept. A doc_id
    with a toxic row goes with all its rows; a null doc_id stays."""
    bad = scored(docs, labels).where("predicted = 1").select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
