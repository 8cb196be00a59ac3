import base64
import hashlib

import numpy as np
import public_tokenizers as P
import tiktoken

import __spark_entry__ as E
import corpus_pipeline
from storeflow.llm import toxicity
from storeflow.llm.stages import documents, table

from .conftest import AWKWARD, DATA
from .test_lines import brute as brute_lines
from .test_simhash import brute as brute_simhash
from .test_windows import brute_overlap


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = documents(spark, DATA)
    kept = [docs]
    for name, step in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        step(spark, kept[-1], DATA).write.parquet(out)
        kept.append(spark.read.parquet(out))
        if name != "byte_bpe":
            assert kept[-1].dtypes == docs.dtypes
    scored = toxicity.scored(docs, table(spark, DATA, "labels")).collect()
    clean = {r.doc_id for r in scored if not r.predicted}
    text = dict(rows(docs))
    assert dict(rows(kept[1])) == {i: t for i, t in text.items() if i in clean}

    before, after = dict(rows(kept[1])), dict(rows(kept[2]))
    gone = {(d, k) for d, k, i, j in brute_lines(list(before.items())) if (d, k) != (i, j)}
    assert gone
    assert after == {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in before.items()}
    assert all(r.n_chars == len(r.text) for r in kept[2].collect())

    stays = {i for i, _, c in brute_simhash(list(after.items())) if i == c}
    assert dict(rows(kept[3])) == {i: t for i, t in after.items() if i in stays}

    items = [(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()]
    dirty = {x[0] for x in brute_overlap(rows(kept[3]), items) if x[-1]}
    last = {i: t for i, t in after.items() if i in stays - dirty}
    assert dict(rows(kept[4])) == last

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    final = {r.doc_id: r for r in kept[5].collect()}
    assert set(final) == set(last)
    for i, t in last.items():
        ids = coder.encode_ordinary(t)
        assert final[i].ids == ids and final[i].n_tokens == len(ids)
        assert final[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert final[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_awkward_rows_pass(spark, make, tmp_path):
    for n, docs in enumerate((make(AWKWARD + [(None, None), (None, "one two three")]), make(AWKWARD).limit(0))):
        columns = docs.columns
        for name, step in corpus_pipeline.STAGES:
            out = str(tmp_path / f"{n}-{name}")
            step(spark, docs, DATA).write.parquet(out)
            docs = spark.read.parquet(out)
            assert docs.columns == columns or name == "byte_bpe"
        assert (docs.count() == 0) == (n == 1)


def test_registered():
    names = E.queries()
    assert "pipeline" in names and "pipeline" not in E.oracle_sql()
    assert all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
