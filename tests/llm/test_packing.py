"""Packing: every piece in one place, no sequence over its length, and few sequences."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import settings as examples
from hypothesis import strategies as st
from tokenizers import Tokenizer

from clicktrail.llm.packing import Places, pack, plan
from clicktrail.llm.queries import TOKENIZER


@examples(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=40), st.integers(1, 12))
def test_a_plan_holds_every_piece_once(histogram, groups):
    bins = plan(histogram, 64, groups)
    got = Counter()
    for b in bins:
        assert sum(b.lengths) == b.used <= 64
        for length in b.lengths:
            got[length] += b.count
    assert got == Counter(histogram)
    places = Places(bins)
    taken = defaultdict(list)
    for length, n in histogram.items():
        sequence, offset = places.of(np.full(n, length), np.arange(n))
        for s, o in zip(sequence.tolist(), offset.tolist(), strict=True):
            taken[s].append((o, o + length))
    assert len(taken) == sum(b.count for b in bins)
    for spans in taken.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))  # noqa: B905


def test_a_plan_is_near_the_bound():
    draw = np.random.default_rng(1)
    lengths = np.minimum(2048, draw.lognormal(5.5, 1.0, 50_000).astype(int) + 1)
    histogram = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    assert sum(b.count for b in plan(histogram, 2048)) <= 1.005 * lengths.sum() / 2048 + 1


def test_perfect_pairs_are_found():
    assert sum(b.count for b in plan({1500: 10, 548: 10, 1024: 20}, 2048)) == 20


def check(rows, texts):
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 0 < r.length <= 2048
        sequences[r.sequence_id].append((r.offset, r.offset + r.length))
        documents[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for spans in sequences.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= 2048
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:]))  # noqa: B905
    wanted = defaultdict(list)
    for doc_id, text in texts:
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 if len(ids) > 2048 and len(ids) % 2048 else min(len(ids), 2048)
        cuts = [0, *range(first, len(ids), 2048), len(ids)]
        wanted[doc_id] += [(i, a, z - a, zlib.crc32(ids[a:z].tobytes())) for i, (a, z) in enumerate(zip(cuts, cuts[1:]))]  # noqa: B905
    assert {k: sorted(v) for k, v in documents.items()} == {k: sorted(v) for k, v in wanted.items()}


def test_odd_rows(odd):
    check(pack(odd, **TOKENIZER).collect(), [(r.doc_id, r.text) for r in odd.collect()])


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pack(docs, **TOKENIZER).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert len({r.sequence_id for r in rows}) <= -(-sum(r.length for r in rows) // 2048) + 2


def test_empty_table(empty):
    assert pack(empty, **TOKENIZER).collect() == []
