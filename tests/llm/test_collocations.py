"""Phrase collocations against brute force, with few and many rounds of growth."""
import random
import re
from collections import Counter

import pytest

from storeflow.llm import collocations as C
from storeflow.llm.stages import documents

from .conftest import AWKWARD, DATA


def brute(docs, top, least):
    """All languages' rows, from (lang, text)."""
    f = {}
    for lang, t in docs:
        t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", t):
            w = re.findall("[^\x20\x09]+", piece)
            for size in range(1, 5):
                for i in range(len(w) - size + 1):
                    f.setdefault(lang or "und", Counter())[tuple(w[i:i + size])] += 1
    out = []
    for lang, count in f.items():
        n = sum(c for g, c in count.items() if len(g) == 1)
        cand = {g: c for g, c in count.items() if len(g) > 1 and c >= least}
        rows = []
        for g, a in cand.items():
            if any(len(h) > len(g) and 100 * c >= 80 * a and any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1)) for h, c in cand.items()):
                continue
            score, _, left, right = min((2_000_000 * a // (count[g[:k]] + count[g[k:]]), k, count[g[:k]], count[g[k:]]) for k in range(1, len(g)))
            rows.append((-score, -a, " ".join(g).encode(), left, right))
        rows.sort()
        out += [(lang, k + 1, g.decode(), -a, left, right, n, -score) for k, (score, a, g, left, right) in enumerate(rows[:top])]
    return sorted(out)


def got(docs, **kw):
    df = C.collocations(docs, **kw)
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


@pytest.fixture(scope="module")
def langs(spark):
    def build(rows):
        return spark.createDataFrame([(k, t, lang, "x", 1) for k, (lang, t) in enumerate(rows)], "doc_id bigint, text string, lang string, phrase string, a int")
    return build


def sentences(rng, words, n):
    """Random text over few words, with some phrases that recur."""
    fixed = [rng.sample(words, k) for k in (2, 3, 4, 5) for _ in range(3)]
    out = []
    for _ in range(n):
        w = rng.choices(words, k=rng.randrange(6))
        out += w + rng.choice(fixed) + [rng.choice([".", ",", "\n", ";", ":", "!", "", "", ""])]
    return " ".join(out)


@pytest.mark.parametrize("seed,top,first", [(1, 5, 2), (2, 40, 3), (3, 2000, 8000)])
def test_random(langs, seed, top, first):
    rng = random.Random(seed)
    rows = [(rng.choice(["en", "en", "de", None, "und"]), sentences(rng, [f"W{k}" for k in range(14)], 60)) for _ in range(30)]
    want = brute(rows, top, 6)
    assert len({x[0] for x in want}) == 3 and (top < 40 or any(len(x[2].split()) == 4 for x in want))
    assert got(langs(rows), top=top, least=6, first=first) == want


def test_rare_words_between_frequent_ones(langs):
    """A four-word phrase whose last three words no prefix of good bound leads to."""
    rng = random.Random(5)
    rows = [("en", "rare the of a. " * 8 + " ".join(rng.choices(["the", "of", "a", "b", "c"], k=3000)))]
    assert got(langs(rows), top=3, least=6, first=1) == brute(rows, 3, 6)


def test_table(spark):
    docs = documents(spark, DATA)
    want = brute([(r.lang, r.text) for r in docs.select("lang", "text").collect()], 50, 8)
    assert len(want) > 50
    assert got(docs, top=50, least=8, first=30) == want


def test_awkward(langs):
    rows = [(None, t) for _, t in AWKWARD] + [("en", "é ü é ü, \tA b\x0bA b " * 40), ("en", "x" * 300 + " " + "y" * 300 + " " + "tail. " * 3)] * 2
    assert got(langs(rows), least=2, top=2000) == brute(rows, 2000, 2)
    assert got(langs(rows), least=2, top=2, first=1) == brute(rows, 2, 2)
    assert got(langs(rows).limit(0)) == []
    assert got(langs([("en", None), ("en", "")])) == []


def test_counts_beyond_64_bits(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(9_000_000_000_000_000_000, 9_100_000_000_000_000_000)], "a bigint, l bigint")
    out = df.select(C._ratio(F.col("a"), C._sum(F.col("l"), F.col("l")))).first()[0]
    assert out == 2_000_000 * 9_000_000_000_000_000_000 // (2 * 9_100_000_000_000_000_000)


@pytest.mark.parametrize("size", [0, 1, 3])
def test_a_worker_holds_one_small_block_at_a_time(monkeypatch, size):
    """8 MB of text in one batch: what a task allocates does not grow with it."""
    import gc
    import tracemalloc

    import pyarrow as pa
    from pyspark.sql import functions as F

    class Table:
        def mapInArrow(self, run, schema):
            self.run = run
            return self

        def groupBy(self, *names):
            return self

        def agg(self, *columns):
            return self

    table, words = Table(), [f"word{k}" for k in range(1000)]
    monkeypatch.setattr(C, "_texts", lambda docs: docs)
    monkeypatch.setattr(F, "sum", lambda name: F)
    monkeypatch.setattr(F, "alias", lambda name: None, raising=False)
    C.counted(table, size) if size else C.pair_hashes(table)
    rng = random.Random(1)
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 400, "text": [" ".join(rng.choices(words, k=2600)) for _ in range(400)]})
    gc.collect()
    tracemalloc.start()
    n = sum(sum(part.column(part.num_columns - 1).to_pylist()) for part in table.run(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    print(size, most / 1e6)
    assert n == 400 * (2600 - (size or 2) + 1) and most < 80e6, most
