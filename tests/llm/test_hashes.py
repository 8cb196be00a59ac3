"""Different spans of bytes are never taken for equal ones: Thue-Morse texts
and their complements, which collide in any polynomial modulo a power of two."""
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from storeflow.llm import byte_bpe, line_dedup, substring_dedup
from storeflow.llm import text as T

from .test_bpe import RANKS, block, counter, library, tokenizer  # noqa: F401
from .test_windows import brute_repeats


def thue_morse(size, a, b):
    return "".join((a, b)[k.bit_count() & 1] for k in range(size))


TWINS = [(thue_morse(n, a, b), thue_morse(n, b, a)) for n in (1024, 4096) for a, b in (("a", "b"), ("xqz", "the"), ("ab ", "ba "), ("of the ", "to the "))]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=90), max_size=40))
def test_equal_spans_only(spans):
    data = np.frombuffer(b"".join(spans), np.uint8)
    ends = np.cumsum([len(x) for x in spans], dtype=np.int64) if spans else np.zeros(0, np.int64)
    starts = ends - np.array([len(x) for x in spans], np.int64)
    for seed in (0, 1):
        h = T.span_hashes(data, starts, ends, seed).tolist()
        assert len(set(zip(spans, h))) == len(set(spans)) == len(set(h))
    one, number = T.distinct_spans(data, starts, ends)
    assert [spans[one[k]] for k in number] == spans and len(one) == len(set(spans))


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(T, "span_hashes", lambda data, starts, ends, seed=0: (ends - starts).astype(np.uint64) // np.uint64(3))
    spans = [b"", b"a", b"b", b"a", b"ab", b"ba", b"abcd", b"", b"ba", b"abce"]
    data, ends = np.frombuffer(b"".join(spans), np.uint8), np.cumsum([len(x) for x in spans])
    one, number = T.distinct_spans(data, ends - [len(x) for x in spans], ends)
    assert [spans[one[k]] for k in number] == spans


def test_seeds_are_independent():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 123, 40000, dtype=np.uint8)
    starts = np.arange(0, 40000, 4)
    a, b = (T.span_hashes(data, starts, starts + 4, seed) for seed in (0, 1))
    same = np.unpackbits((a ^ b).view(np.uint8)).mean()
    assert 0.49 < same < 0.51 and len(np.unique(a ^ b)) > 1


@pytest.mark.parametrize("twins", TWINS)
def test_tokens(library, counter, tokenizer, twins):  # noqa: F811
    data, offsets = block(twins)
    ids, first = byte_bpe.encode_block(data, offsets, byte_bpe.ranks(RANKS))
    assert [ids[first[i]: first[i + 1]].tolist() for i in (0, 1)] == [library.encode_ordinary(t) for t in twins]
    assert counter.block(data, offsets).tolist() == [len(x.ids) for x in tokenizer.encode_batch(list(twins), add_special_tokens=False)]


def test_documents(make):
    words = [f"w{k}" for k in range(12)]
    rows = [(2 * k + side, " ".join([*words[:6], twin.replace(" ", ""), *words[6:]])) for k, pair in enumerate(TWINS) for side, twin in enumerate(pair)]
    got = substring_dedup.repeated(make(rows)).drop("removed").collect()
    assert sorted(map(tuple, got), key=str) == brute_repeats(rows)
    coded = byte_bpe.round_trip(make(rows), P.path("byte_bpe_50k.tiktoken")).collect()
    assert {r.doc_id: r.decoded_sha256 for r in coded} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in rows}


def test_lines(make):
    rows = [(1, TWINS[1][0]), (2, TWINS[1][1]), (3, TWINS[1][0])]
    h = {r.doc_id: (r.h, r.n_words) for r in line_dedup.lines(make(rows)).collect()}
    assert h[1] == h[3] and h[1][0] != h[2][0]
