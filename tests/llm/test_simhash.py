import re

import numpy as np
import pytest
import xxhash

from storeflow.llm import simhash_dedup as S
from storeflow.llm.stages import documents

from .conftest import AWKWARD, DATA


def brute_fp(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows):
    fp = [(i, brute_fp(t)) for i, t in rows]
    distinct = sorted({f for _, f in fp})
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if (a ^ b).bit_count() <= 2:
                root[find(b)] = find(a)
    least = {}
    for i, f in fp:
        least[find(f)] = min(i, least.get(find(f), i))
    return sorted((i, f"{f:016x}", least[find(f)]) for i, f in fp)


def got(df):
    return sorted((r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


def test_against_brute_force(spark):
    docs = documents(spark, DATA)
    assert got(S.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_awkward_rows(make):
    assert got(S.near_duplicates(make(AWKWARD))) == brute(AWKWARD)


def test_empty_table(make):
    assert got(S.near_duplicates(make(AWKWARD).limit(0))) == []


@pytest.mark.parametrize("bits", [0, 1, 2])
def test_links_by_pairs_and_by_neighbours(spark, monkeypatch, bits):
    rng = np.random.default_rng(3)
    centres = rng.integers(-2**63, 2**63, 12)
    fps = set()
    for c in centres:
        for _ in range(60):
            v = int(c) & (2**64 - 1)
            for b in rng.integers(0, 64, 3):
                v ^= (1 << int(b)) if rng.random() < 0.7 else 0
            fps.add(v - 2**64 if v >= 2**63 else v)
    prints = spark.createDataFrame([(f,) for f in fps], "fp bigint")

    def parts(edges):
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for a, b in edges:
            root[find(a)] = find(b)
        out = {}
        for f in fps:
            out.setdefault(find(f), set()).add(f)
        return sorted(sorted(x) for x in out.values())

    order = sorted(fps)
    want = parts([(a, b) for i, a in enumerate(order) for b in order[i + 1:] if ((a ^ b) & (2**64 - 1)).bit_count() <= bits])
    for limit in (2, 32, 10**6):
        monkeypatch.setattr(S, "PAIRWISE", limit)
        assert parts([(r.a, r.b) for r in S.links(prints, bits).collect()]) == want


def test_near_indices_meet():
    rng = np.random.default_rng(1)
    v = rng.integers(0, 1 << 23, 400)
    for n in (1, 2):
        w = v.copy()
        for i in range(len(w)):
            for b in rng.choice(23, n, replace=False):
                w[i] ^= 1 << int(b)
        for x, y in zip(S.near_indices(v), S.near_indices(w)):
            assert set(x[x >= 0]) & set(y[y >= 0])
