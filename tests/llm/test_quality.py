"""The quality classifier: terms, votes and whole scores against plain programs, held-out accuracy."""
import math
import re
from collections import Counter

import numpy as np
import pytest

from storeflow.llm import quality as Q
from storeflow.llm import text as T
from storeflow.llm.stages import documents, table

from .conftest import AWKWARD, DATA

LARGER = "/root/testdata/sf0.01"


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw])


def span(text, seed=0):
    data = np.frombuffer(text.encode(), np.uint8)
    return int(T.span_hashes(data, np.zeros(1, np.int64), np.array([len(data)]), seed)[0])


def shape(token):
    sign = "".join("A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" else "0" if "0" <= c <= "9" else c for c in token if ord(c) < 128)
    return re.sub(r"(.)\1+", r"\1", sign, flags=re.S)


def plain_terms(t):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), t)
    tokens = re.findall("[^\x20\x09-\x0d]+", t)
    words = [span(x) for x in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)]
    return Counter(words + [span(shape(x), 5) for x in tokens] + [int(Q._AGAIN)] * sum(a == b for a, b in zip(tokens, tokens[1:])))


TEXTS = ["", " \n", "One one ONE one one", "AB!! CD!!", "é Üa 42x,, 42x,, | |", "\x00\x1c <<a>> ", "Word&&& word%%%", "x" * 300 + " y"]


def test_terms():
    data, offsets = block(TEXTS)
    text, term, _ = Q.text_terms(data, offsets)
    for k, t in enumerate(TEXTS):
        assert Counter(term[text == k].tolist()) == plain_terms(t)


def plain_score(model, t):
    x = {}
    for term, times in plain_terms(t).items():
        k = int(np.searchsorted(model.terms, np.uint64(term)))
        if k < len(model.terms) and int(model.terms[k]) == term:
            x[k] = (1 + math.log(times)) * model.weights[k]
    length = math.sqrt(sum(v * v for v in x.values()))
    v = [sum(x[k] / max(length, 1e-12) * float(model.basis[k][d]) for k in sorted(x)) for d in range(model.basis.shape[1])]
    length = math.sqrt(sum(c * c for c in v))
    v = [round(c / length * (1 << Q.STEPS)) for c in v] if length > 1e-9 else [0] * len(v)
    cosine = [sum(int(a) * b for a, b in zip(p, v)) for p in model.points]
    if not any(v):
        return model.share
    least = sorted(cosine, reverse=True)[min(Q.NEIGHBOURS, len(cosine)) - 1]
    near = [(c, y) for c, y in zip(cosine, model.labels) if c >= least and c > 0]
    weight = [(c / (1 << 2 * Q.STEPS)) ** Q.POWER for c, _ in near]
    return sum(w * y for w, (_, y) in zip(weight, near)) / sum(weight) if near else model.share


def test_whole_scores(spark):
    docs, labels = documents(spark, DATA), table(spark, DATA, "labels")
    model = Q.fit(docs, labels)
    assert len(model.points) == len(model.labels) > 50 and set(model.labels) == {0.0, 1.0}
    texts = [r.text or "" for r in docs.select("text").collect()][:60] + TEXTS
    data, offsets = block(texts)
    from storeflow.llm.decontamination import Lookup
    found = Q.votes(model, Q.vectors(model, Lookup(model.terms), data, offsets), rows=7)
    assert np.allclose(found, [plain_score(model, t) for t in texts], atol=1e-4)


def test_document_frequencies_cover_all_documents(spark, make):
    docs = make([(1, "one two two"), (2, "TWO three"), (3, None), (None, "two")])
    terms = np.sort(np.array([span("two"), span("three"), span("five")], np.uint64))
    met = {r.code: r.n for r in Q.document_frequencies(Q.keyed_text(docs).select("text"), spark.sparkContext.broadcast(terms)).collect()}
    assert met == {-1: 4, int(np.searchsorted(terms, np.uint64(span("two")))): 3, int(np.searchsorted(terms, np.uint64(span("three")))): 1}


def test_votes_of_ties():
    """All rows as near as the last neighbour vote, in any order."""
    points = np.repeat(np.eye(4) * (1 << Q.STEPS), 40, axis=0)
    labels = np.arange(160) % 4 == 0
    model = Q.Model(np.zeros(1, np.uint64), np.ones(1), np.zeros((1, 4)), points, labels.astype(float), 0.7)
    v = np.array([[1, 0, 0, 0], [0, -1, 0, 0], [0, 0, 0, 0]]) * (1 << Q.STEPS)
    assert Q.votes(model, v).tolist() == [0.25, 0.7, 0.7]
    order = np.random.default_rng(1).permutation(160)
    model.points, model.labels = points[order], labels[order].astype(float)
    assert Q.votes(model, v).tolist() == [0.25, 0.7, 0.7]


def test_held_out_accuracy(spark):
    """AUC on rows that did not teach, and on planted junk of the same kinds."""
    docs, labels = documents(spark, LARGER), table(spark, LARGER, "labels")
    rows = Q.scored(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert len(good) > 30 and len(bad) > 5
    assert sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum(r.predicted for r in rows if r.quality) >= 0.97 * len(good)


def test_labels_lang_source_and_ids_are_no_inputs(spark):
    from pyspark.sql import functions as F
    docs, labels = documents(spark, DATA), table(spark, DATA, "labels")
    fold = ~Q.held_out()
    told = {r.doc_id: r.score for r in Q.scored(docs, labels).collect()}
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    flipped = labels.withColumn("quality", F.when(fold, F.col("quality")).otherwise(1 - F.col("quality")))
    assert {r.doc_id: r.score for r in Q.scored(other, flipped).collect()} == told


def test_awkward(spark, make):
    rows = AWKWARD + [(k, f"plain text number {k} of some words") for k in range(40, 60)] + [(k, "JUNK!! " * k) for k in range(60, 80)] + [(None, "JUNK!!"), (41, "zzz")]
    labels = spark.createDataFrame([(k, int(k < 60)) for k in range(40, 80)] + [(61, None), (None, 1), (7, 1)], "doc_id bigint, quality int")
    found = Q.scored(make(rows), labels).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    score = {r.doc_id: r.score for r in found}
    assert score[70] < 0.3 < score[50] and score[None] < 0.3
    assert score[1] == score[2] == pytest.approx(sum(1 for k in range(40, 60) if not held(k)) / sum(1 for k in range(40, 80) if not held(k)), abs=0.1)
    assert Q.scored(make(rows).limit(0), labels).collect() == []
    assert {r.score for r in Q.scored(make(rows), labels.limit(0)).collect()} == {0.5}


def held(k):
    import zlib
    return zlib.crc32(str(k).encode()) % 5 == 0
