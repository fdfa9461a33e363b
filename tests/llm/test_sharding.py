"""Sharding against a heap that takes the groups one by one."""

import heapq
import zlib
from collections import defaultdict

from hypothesis import given
from hypothesis import settings as examples
from hypothesis import strategies as st

from clicktrail.llm.sharding import longest_first, shard
from tests.llm.conftest import frame


def one_by_one(sizes, shards):
    heap = [(0, s) for s in range(shards)]
    for size, count in sizes:
        for _ in range(count):
            load, s = heapq.heappop(heap)
            heapq.heappush(heap, (load + size, s))
    return sorted(load for load, _ in heap)


@examples(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 500), st.integers(1, 200), max_size=12), st.integers(1, 9))
def test_counts_equal_a_heap_one_by_one(histogram, shards):
    sizes = sorted(histogram.items(), reverse=True)
    plan = longest_first(sizes, shards)
    loads = [0] * shards
    for (size, count), got in zip(sizes, plan, strict=True):
        assert sum(got) == count
        loads = [x + size * n for x, n in zip(loads, got, strict=True)]
    assert sorted(loads) == one_by_one(sizes, shards)


def check(rows, texts_by_id=None):
    by_shard, by_text = defaultdict(list), defaultdict(set)
    for r in rows:
        by_shard[r.shard].append(r.slot)
        by_text[(r.size, r.text_crc32)].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
    assert all(sorted(slots) == list(range(len(slots))) for slots in by_shard.values())
    assert all(len(s) == 1 for s in by_text.values())


def test_odd_rows(odd):
    rows = shard(odd).collect()
    assert len(rows) == odd.count()
    check(rows)
    texts = sorted((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in rows) == texts


def test_empty_table(empty):
    assert shard(empty).collect() == []


def test_a_hot_group_stays_together_and_the_rest_is_level(spark):
    texts = ["hot text"] * 100 + [f"text {i} " * (i % 7 + 3) for i in range(600)]
    rows = shard(frame(spark, texts)).collect()
    check(rows)
    assert len({r.shard for r in rows[:0] or rows if r.size == 9}) == 1
    loads = defaultdict(int)
    for r in rows:
        loads[r.shard] += r.size
    assert max(loads.values()) - min(loads.values()) < 60


def test_given_documents_are_level(documents):
    loads = {r[0]: r[1] for r in shard(documents).groupBy("shard").sum("size").collect()}
    assert len(loads) == 8
    assert max(loads.values()) / min(loads.values()) < 1.01
