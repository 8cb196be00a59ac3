import hashlib

from storeflow.llm import merkle as M
from storeflow.llm.stages import documents

from .conftest import AWKWARD, DATA


def brute(docs):
    """(doc_id, n_chars, SHA-256 of the edited text) in descending doc_id;
    equal ids in any order."""
    rows = sorted(docs, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + nxt[:n]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    return out


def test_table(spark):
    docs = documents(spark, DATA)
    rows = M.edited_fingerprints(docs).collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == sorted(brute(list(texts.items())))
    by_text = {}
    for r in rows:
        assert by_text.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert len(set(by_text.values())) == len(by_text)
    long = [r for r in rows if r.n_chars > 300]
    assert sum(r.near_edited for r in long) / len(long) > 0.5
    assert sum(r.near_edited > r.near_next for r in long) > 0.95 * len(long)


def test_awkward_rows(make):
    rows = M.edited_fingerprints(make(AWKWARD)).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == sorted(brute(AWKWARD))
    prints = {}
    for r in rows:
        prints.setdefault(r.fingerprint, set()).add(r.doc_id)
    assert {1, 2} in prints.values() and {7, 8} in prints.values()
    assert len(prints) == len({t or "" for _, t in AWKWARD})


def test_null_ids_one_row_and_none(make):
    rows = [(None, "abc def"), (5, "xyz uvw"), (3, None)]
    got = M.edited_fingerprints(make(rows)).collect()
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(brute(rows), key=str)
    one = M.edited_fingerprints(make([(1, "abcdef")])).collect()[0]
    assert one.near_next == 1.0 and one.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest()
    assert M.edited_fingerprints(make(rows).limit(0)).collect() == []


def test_differing_branches(make):
    a = "\n".join(f"line number {i} of a text" for i in range(40))
    b = a.replace("number 17", "NUMBER 17").replace("number 33", "x") + "\nmore"
    df = make([(1, a)]).withColumn("edited", M.F.lit(b))
    tree = M.with_tree(M.with_tree(df, "text", ""), "edited", "edited_")
    assert tree.select(M.differing("", "edited_").alias("d")).first().d == [17, 33, 40]


def test_white_space_tells_texts_apart(make):
    df = M.with_tree(make([(1, "a. \tb"), (2, "a.\t b"), (3, "a. b"), (4, "a.  b"), (5, "a. b\n"), (6, "\na. b")]), "text", "")
    assert df.select("root").distinct().count() == 6


def test_plan_has_no_python(spark):
    plan = M.edited_fingerprints(documents(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
