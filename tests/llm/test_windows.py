"""Benchmark decontamination and substring dedup against brute force."""
import hashlib
import random
import re

import numpy as np
import pytest

from storeflow.llm import decontamination as D
from storeflow.llm import substring_dedup as S
from storeflow.llm.stages import documents, table

from .conftest import AWKWARD, DATA

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def alnum(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_overlap(docs, items):
    windows = {}
    for item, t in items:
        w = alnum(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[i:i + 13]), set()).add("" if item is None else str(item))
    out = []
    for i, t in docs:
        w, hit, found = alnum(t), set(), set()
        for a in range(len(w)):
            for n in range(1, 14):
                if a + n <= len(w) and tuple(w[a:a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a:a + n])]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def got_overlap(docs, items, **kw):
    from pyspark.sql import functions as F
    df = D.judged(D.overlap(docs, items, **kw)).select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated")
    return sorted((tuple(r) for r in df.collect()), key=str)


ITEMS = [(1, None), (2, ""), (3, "one"), (3, "One two!"), (4, "a b c d e f g h i j k l m n o"), (None, "word word word"), (5, "ONE"),
         (6, "b c d e f g h i j k l m n"), (7, "é ü")]
DOCS = AWKWARD + [(20, "x a b c d e f g h i j k l m n o y"), (21, "a b c d e f g h i j k l m"), (22, "ONE, two; three"), (None, "one")]


def test_overlap_awkward(spark, make):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    docs = [(i, t if t is None or len(t) < 1000 else t[:500]) for i, t in DOCS]
    assert got_overlap(make(docs), items) == brute_overlap(docs, ITEMS)
    assert got_overlap(make(docs), items, block_bytes=20) == brute_overlap(docs, ITEMS)
    assert got_overlap(make(docs), items.limit(0)) == brute_overlap(docs, [])
    assert got_overlap(make(docs).limit(0), items) == []


def test_overlap_table(spark):
    docs, items = documents(spark, DATA), table(spark, DATA, "benchmark")
    d = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    b = [(r.item_id, r.text) for r in items.collect()]
    assert got_overlap(docs, items) == brute_overlap(d, b)
    left = {r.doc_id for r in D.clean(docs, items).select("doc_id").collect()}
    assert left == {x[0] for x in brute_overlap(d, b) if not x[-1]}


def brute_repeats(docs):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    least = {}
    for i, w in words:
        for a in range(len(w) - 12):
            if i is not None:
                k = tuple(w[a:a + 13])
                least[k] = min(i, least.get(k, i))
    out = []
    for i, w in words:
        gone = set()
        for a in range(len(w) - 12):
            if i is not None and least[tuple(w[a:a + 13])] < i:
                gone |= set(range(a, a + 13))
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=str)


def got_repeats(df):
    return sorted((tuple(r)[:4] for r in S.repeated(df).collect()), key=str)


def test_repeats_table(spark):
    docs = documents(spark, DATA)
    want = brute_repeats([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sum(x[2] > 0 for x in want) > 5
    assert got_repeats(docs) == want


def test_repeats_awkward(make):
    long = " ".join(f"w{i}" for i in range(40))
    rows = AWKWARD + [(30, long), (31, "x " + long[:-4]), (31, long), (29, "word " * 13), (28, "word " * 12), (None, long), (32, "a b " * 30), (33, "z a b " + "a b " * 9)]
    assert got_repeats(make(rows)) == brute_repeats(rows)
    assert got_repeats(make(rows).limit(0)) == []


@pytest.mark.parametrize("alphabet", [2, 3, 30])
def test_repeats_random(make, alphabet):
    rng = random.Random(alphabet)
    base = [rng.choices([f"v{i}" for i in range(alphabet)], k=400) for _ in range(4)]
    rows = []
    for i in range(40):
        w = []
        for _ in range(4):
            b, a = rng.choice(base), rng.randrange(390)
            w += b[a: a + rng.randrange(5, 40)] + rng.choices([f"u{i}" for i in range(3)], k=rng.randrange(3))
        rows.append((rng.randrange(30), " ".join(w)))
    assert got_repeats(make(rows)) == brute_repeats(rows)


def test_signs_depend_on_the_window_alone():
    rng = np.random.default_rng(2)
    from storeflow.llm import text as T
    window = rng.integers(0, 6, 13)
    seen = set()
    for _ in range(200):
        left, right = rng.integers(0, 6, rng.integers(0, 20)), rng.integers(0, 6, rng.integers(0, 20))
        raw = " ".join(map(str, [*left, *window, *right])).encode()
        data = np.frombuffer(raw, np.uint8)
        w = T.words(data, np.array([0, len(data)]), T.NOT_SPACE)
        start, sign = S.signs(w, w.hashes())
        seen.add(int(sign[start.tolist().index(len(left))]))
    assert len(seen) == 1
