import os
import sys

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", ".."))
import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from storeflow.session import local_session
    return local_session(8, shuffle_partitions=8)


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) rows, with extra columns whose names
    clash with the operators' own."""
    def build(rows):
        return spark.createDataFrame(
            [(i, t, "en", "src0", None if t is None else len(t), "x", 1) for i, t in rows],
            "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, key int")
    return build


#: nulls, empty and blank texts, repeated rows, ties, odd bytes, one long text
AWKWARD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two"), (6, "One  two\tthree\n"), (7, "one two three"),
    (8, "one two three"), (8, "one two three"), (9, "\x00\x1c\x85 é ü \U0001f600"), (10, "word " * 30000),
    (11, "x" * 70000), (12, "a\n\nb\n"), (13, "'s 're''ll <|endoftext|> \r\n  z"),
]
