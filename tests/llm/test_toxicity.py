import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from storeflow.llm import toxicity as X
from storeflow.llm.stages import documents, table

from .conftest import AWKWARD


def brute_segments(s):
    """Maximal-scoring segments by their definition: the best segment (the
    shortest, then leftmost, of equals), then the same on either side."""
    best = max(((round(sum(s[a:b]), 9), a - b, -a) for a in range(len(s)) for b in range(a + 1, len(s) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    a = -best[2]
    b = a - best[1]
    return brute_segments(s[:a]) + [(a, b)] * 1 + [(x + b, y + b) for x, y in brute_segments(s[b:])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-5, 5).map(lambda v: v + 0.013 * (v % 3) if v else -0.5), max_size=14))
def test_segments_are_maximal(s):
    want = brute_segments(s)
    got = [(a, b) for a, b, _ in X.maximal_segments(s)]
    # ties may be cut at other places: compare scores, and places where they are unique
    assert np.allclose([sum(s[a:b]) for a, b in got], [sum(s[a:b]) for a, b in want])


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(-3, 3).filter(lambda v: abs(v) > 1e-3), min_size=1, max_size=60))
def test_runs_of_one_sign_give_the_same_segments(s):
    one, two = X.maximal_segments(s), X._text_segments(np.array(s))
    assert [(a, b) for a, b, _ in one] == [(a, b) for a, b, _ in two]
    assert np.allclose([x for *_, x in one], [x for *_, x in two])


def test_linear_time():
    s = np.tile([1.0, -0.4], 100_000)
    s[::7] = -0.9
    assert X._text_segments(s)


def test_rate_solves_its_equation():
    s, p = np.array([-0.2, 3.0, -1.0]), np.array([0.9, 0.01, 0.09])
    r = X.decay_rate(s, p)
    assert abs((p * np.exp(r * s)).sum() - 1) < 1e-6


def auc(score, label):
    order = np.argsort(score, kind="stable")
    ranks = np.empty(len(score))
    for v in np.unique(score):
        ranks[score == v] = np.mean(np.flatnonzero(score[order] == v)) + 1
    n1 = label.sum()
    return (ranks[label == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(label) - n1))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = X.scored(documents(spark, sf), table(spark, sf, "labels")).select("doc_id", "held_out", "score", "predicted").toPandas()
    assert len(got) == 10000 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    both = got.merge(table(spark, sf, "labels").toPandas(), on="doc_id")
    test = both[both.held_out]
    assert ((test.predicted == 1) == (test.score >= 0.5)).all()
    print("held-out", len(test), "auc", auc(test.score.to_numpy(), test.toxic.to_numpy()), "accuracy", (test.predicted == test.toxic).mean())
    assert auc(test.score.to_numpy(), test.toxic.to_numpy()) > 0.85
    assert (test.predicted == test.toxic).mean() > 0.93


def planted(n=400):
    rng = random.Random(1)
    docs, labels = [], []
    for i in range(n):
        w = [f"w{int(rng.paretovariate(1))}" for _ in range(rng.randrange(20, 80))]
        bad = i % 4 == 0
        if bad:
            at = rng.randrange(len(w))
            w[at:at] = ["vile"] * 3
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_planted_passages_are_found(spark, make):
    docs, labels = planted()
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    rows = {r.doc_id: r for r in X.scored(make(docs), known).collect()}
    assert [rows[i].predicted for i, _ in docs] == [t for *_, t in labels]
    for i, t in docs:
        if i % 4 == 0:
            best = max(rows[i].segments, key=lambda x: x.score)
            assert "vile" in t.split()[best.begin: best.end]
    kept = X.clean(make(docs), known)
    assert kept.columns == make(docs).columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs if i % 4}


def test_awkward_rows(spark, make):
    docs, labels = planted(80)
    rows = docs + [(1000 + i, t) for i, t in AWKWARD] + [(None, "vile vile vile"), (None, None)]
    known = spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None), (4, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = X.scored(make(rows), known).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    low = min(r.score for r in got)
    assert all(r.score == low for r in got if r.n_words == 0)
    none = X.scored(make(rows), known.limit(0)).collect()
    assert len(none) == len(rows) and all(r.predicted == 0 for r in none)
    assert X.scored(make(rows).limit(0), known).collect() == []


def test_words_do_not_share_counts(spark, make):
    """A vocabulary larger than any fixed table of buckets keeps words apart."""
    docs, labels = planted()
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    many = [(10_000 + d, " ".join(f"{d}x{k}" for k in range(2000))) for d in range(400)]
    rows = {r.doc_id: r for r in X.scored(make(docs + many), known).collect()}
    assert [rows[i].predicted for i, _ in docs] == [t for *_, t in labels]
    assert all(not rows[i].segments for i, _ in many)  # words of no labelled document
    counted = X.word_counts(make(docs + many).select("doc_id", "text"), known.select("doc_id", "toxic"))
    assert counted.count() == len({x for _, t in docs + many for x in t.split()})
