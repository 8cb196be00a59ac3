import base64
import hashlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from storeflow.llm import byte_bpe, pretoken, token_counts
from storeflow.llm.stages import documents

from .conftest import AWKWARD, DATA

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def counter():
    return token_counts.Counter(JSON)


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(JSON)


def block(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(x) for x in raw])


PIECES = st.lists(st.sampled_from(["'", "'s", "'re", "'ll", "'v", "'l", "r", "e", "s", "don", "The", " ", "  ", "\n", "\t", "\r\n", " ", "　",
                                   "1", "42", "é", "ß", "!", "...", "_", "\x1c", "\x85", "\U0001f600", "世界", "aaaa", "x" * 60, "ab" * 40, "<|endoftext|>", "-"]),
                  max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES | st.text(max_size=30), max_size=6))
def test_random_texts(library, counter, tokenizer, texts):
    data, offsets = block(texts)
    table = byte_bpe.ranks(RANKS)
    ids, first = byte_bpe.encode_block(data, offsets, table)
    for i, t in enumerate(texts):
        assert ids[first[i]: first[i + 1]].tolist() == library.encode_ordinary(t)
    assert table.decode(ids).tobytes() == data.tobytes()
    want = [len(x.ids) for x in tokenizer.encode_batch(texts, add_special_tokens=False)] if texts else []
    assert counter.block(data, offsets).tolist() == want


def test_tokens_are_their_own_encoding(library):
    table = byte_bpe.ranks(RANKS)
    tokens = [library.decode_single_token_bytes(i) for i in range(table.n)]
    data = np.frombuffer(b"".join(tokens), np.uint8)
    at = np.cumsum([0] + [len(t) for t in tokens])
    ids, offsets = table.encode_pieces(data, at[:-1], at[1:])
    assert ids.tolist() == list(range(table.n)) and offsets.tolist() == list(range(table.n + 1))


def test_long_rows(library, counter, tokenizer):
    rng = np.random.default_rng(0)
    texts = ["a" * 5000, "".join(rng.choice(list("abcdeth"), 20000)), "e" * 4097 + "s", "".join(rng.choice(list("aé世"), 3000))]
    data, offsets = block(texts)
    ids, first = byte_bpe.encode_block(data, offsets, byte_bpe.ranks(RANKS))
    for i, t in enumerate(texts):
        assert ids[first[i]: first[i + 1]].tolist() == library.encode_ordinary(t)
    assert counter.block(data, offsets).tolist() == [len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]


def test_chunk_maps_compose():
    rng = np.random.default_rng(5)
    classes = rng.integers(0, pretoken.N_CLASSES, 5000).astype(np.uint8)
    go, _ = pretoken.machine()
    state, before = pretoken.CLOSED, []
    for k, c in enumerate(classes[: 39 * pretoken.CHUNK]):
        if k % pretoken.CHUNK == 0:
            before.append(state)
        state = go[state * pretoken.N_CLASSES + c]
    grid = classes[: 39 * pretoken.CHUNK].reshape(39, -1)
    assert pretoken.scan_maps(pretoken.chunk_maps(grid)).tolist() == before


def rows_of(spark, make, which):
    if which == "table":
        df = documents(spark, DATA)
        return df, [(r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()]
    return make(AWKWARD), [(i, t or "") for i, t in AWKWARD]


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_queries_against_libraries(spark, make, library, tokenizer, which):
    df, rows = rows_of(spark, make, which)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(t.encode())) for i, t in rows for x in [library.encode_ordinary(t)])
    assert sorted(tuple(r) for r in byte_bpe.round_trip(df, RANKS).collect()) == want
    want = sorted((i, len(t.encode()), len(tokenizer.encode(t, add_special_tokens=False).ids)) for i, t in rows)
    assert sorted(tuple(r) for r in token_counts.count_tokens(df, JSON).collect()) == want


def test_ids_and_bytes(make):
    coded = byte_bpe.encode(make(AWKWARD), RANKS)
    back = {r.doc_id: bytes(r.bytes).decode() for r in byte_bpe.decode(coded, RANKS).collect()}
    assert back == {i: t or "" for i, t in AWKWARD}


def test_empty_table(make):
    none = make(AWKWARD).limit(0)
    assert byte_bpe.round_trip(none, RANKS).collect() == token_counts.count_tokens(none, JSON).collect() == []
