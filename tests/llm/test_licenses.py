import math
import re
from collections import Counter

from storeflow.llm import licenses as L
from storeflow.llm.queries import QUERIES
from storeflow.llm.stages import documents

from .conftest import AWKWARD, DATA


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(files, header=L.HEADER, whole=L.WHOLE):
    """(doc_id, path, license, origin, from_directory) by plain loops."""
    templates = {k: terms(v) for k, v in L.TEMPLATES.items()}
    words = [terms(t) for _, _, t in files]
    vocabulary = {t for x in templates.values() for t in x}
    df = Counter(t for w in words for t in set(w) & vocabulary)
    idf = lambda t: math.log((1 + len(files)) / (1 + (df[t] if t in vocabulary else 0))) + 1

    def cosine(x, y):
        x, y = Counter(x), Counter(y)
        norm = lambda c: math.sqrt(sum((n * idf(t)) ** 2 for t, n in c.items()))
        return sum(n * x[t] * idf(t) ** 2 for t, n in y.items()) / (norm(x) * norm(y)) if x else 0.0

    found, declared = [], {}
    for (i, path, _), w in zip(files, words):
        best = (0.0, None)
        for k, t in sorted(templates.items()):
            at = min(range(len(t)), key=lambda j: (-round(idf(t[j]), 12), j))
            for p in (p for p, x in enumerate(w) if x == t[at]):
                s = round(cosine(w[max(p - at, 0): p - at + len(t)], t), 9)
                if s > best[0]:
                    best = s, k
        full = max(((round(cosine(w, t), 9), k) for k, t in sorted(templates.items())), key=lambda x: x[0], default=(0, None))
        name = bool(path is not None and re.match(L.LICENCE_NAMES, path.rpartition("/")[2]))
        is_file = full[0] >= whole or (name and best[0] >= header)
        own = (full if full[0] >= whole else best) if is_file else (best if best[0] >= header else None)
        found.append((i, path, own, is_file))
        if is_file and path is not None:
            d = path.rpartition("/")[0]
            declared[d] = min(declared.get(d, (1, "")), (-own[0], own[1]))
    out = []
    for i, path, own, is_file in found:
        up, place = None, None
        if path is not None and not own:
            parts = path.split("/")[:-1]
            for n in range(len(parts), -1, -1):
                d = "/".join(parts[:n])
                if d in declared:
                    up, place = declared[d][1], d
                    break
        out.append((i, path, own[1] if own else up, "file" if is_file else "header" if own else "inherited" if up else None, place))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.path, r.license, r.origin, r.from_directory) for r in df.collect()), key=str)


FILES = [
    (1, "LICENSE", "Released under the MIT License."), (2, "a/b.txt", "nothing here"), (3, "a/COPYING", "x y z " * 50 + L.TEMPLATES["GPL-3.0"]),
    (4, "a/b/c/d.txt", "more text"), (5, "a/b/LICENSE.md", L.TEMPLATES["Apache-2.0"]), (6, "a/b/e.txt", "/* licensed UNDER the apache license version 2.0 */ " + "code " * 30),
    (7, "z/f.txt", "Licensed under the Apache License, Version 2.0. Licensed under CC BY-NC 4.0."), (8, None, "Released under the MIT License."), (9, None, "x"),
    (10, "a/b/c/notice", "Released### under%%% the*** MIT&&& License.$$$ " + "word " * 100), (11, "a/b/c/deep/er/x", ""), (12, "a/b/c/deep/y", None), (13, "top.txt", "t"),
]


def test_small_tree(spark):
    files = spark.createDataFrame(FILES, "doc_id int, path string, text string")
    want = brute(FILES)
    assert {(i, lic, o) for i, _, lic, o, _ in want} >= {(2, "GPL-3.0", "inherited"), (4, "MIT", "inherited"), (6, "Apache-2.0", "header"), (13, "MIT", "inherited"), (11, "MIT", "inherited")}
    assert got(L.scan(files)) == want
    assert got(L.scan(files.limit(0))) == []
    assert all(r.license is None for r in L.scan(files, {}).collect())


def test_table(spark):
    rows = [(r.doc_id, f"{r.source}/{r.lang}/{r.doc_id}.txt", r.text) for r in documents(spark, DATA).collect()]
    assert got(QUERIES["op10_license_scan"](spark, DATA)) == brute(rows)


def test_awkward_rows(make):
    df = make(AWKWARD).selectExpr("doc_id", "concat('d/', doc_id) as path", "text", "fp", "key")
    assert got(L.scan(df)) == brute([(i, f"d/{i}", t) for i, t in AWKWARD])


def test_passage_without_the_rarest_term(spark):
    """A header, and a whole text, that has every term of a template but the
    rarest is found; a passage may lie anywhere in its text."""
    words = [f"term{k}" for k in range(32)]
    notice = " ".join(["other", *words[1:]])
    files = spark.createDataFrame([(1, "a/x", "code " * 40 + notice + " code" * 40), (2, "b/y", notice), (3, "c/z", "code " * 20 + " ".join(words[1:8]))], "doc_id int, path string, text string")
    rows = {r.doc_id: (r.license, r.origin) for r in L.scan(files, {"N-1": " ".join(words)}).collect()}
    assert rows == {1: ("N-1", "header"), 2: ("N-1", "file"), 3: (None, None)}
