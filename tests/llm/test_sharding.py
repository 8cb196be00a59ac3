import zlib
from collections import defaultdict

import pytest

from storeflow.llm import sharding as S
from storeflow.llm.stages import documents

from .conftest import AWKWARD, DATA


def check(rows, docs, n):
    """Every row once; right sizes and CRCs; gapless slots; groups together
    unless larger than a shard's target; bytes near equal."""
    raw = [(i, (t or "").encode()) for i, t in docs]
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((i, len(b) + 8, zlib.crc32(b)) for i, b in raw)
    slots, size, where, weight = defaultdict(list), defaultdict(int), defaultdict(set), defaultdict(int)
    for r in rows:
        assert 0 <= r.shard < n
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
        where[r.text_crc32, r.size].add(r.shard)
        weight[r.text_crc32, r.size] += r.size
    for s in slots.values():
        assert sorted(s) == list(range(len(s)))
    target = sum(size.values()) / n
    for g, shards in where.items():
        assert len(shards) == 1 or weight[g] > target
    return [size[s] for s in range(n)], target, weight


def test_table(spark):
    docs = documents(spark, DATA)
    rows = S.shards(docs).collect()
    size, target, weight = check(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], 24)
    largest = max(w for w in weight.values() if w <= target)
    assert max(size) <= target + largest and min(size) >= target - largest


def test_hot_group_is_dealt(make):
    rows = [(i, "copy " * 40) for i in range(600)] + [(1000 + i, f"other {i} " * (i % 30)) for i in range(600)]
    got = S.shards(make(rows), 8).collect()
    size, target, _ = check(got, rows, 8)
    assert max(size) < 1.25 * target and min(size) > 0.75 * target


@pytest.mark.parametrize("n", [1, 2, 5, 24])
def test_awkward_rows(make, n):
    check(S.shards(make(AWKWARD), n).collect(), AWKWARD, n)


def test_equal_rows_only(make):
    rows = [(i % 3, "same") for i in range(50)]
    check(S.shards(make(rows), 4).collect(), rows, 4)


def test_empty_table(make):
    assert S.shards(make(AWKWARD).limit(0)).collect() == []


def test_plan_has_no_python(spark):
    plan = S.shards(documents(spark, DATA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
