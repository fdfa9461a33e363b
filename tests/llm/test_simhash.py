"""Fingerprints against a plain computation, and the search against all pairs."""

import hashlib
import re

import xxhash
from hypothesis import HealthCheck, given
from hypothesis import settings as examples
from hypothesis import strategies as st

from clicktrail.llm import simhash
from tests.llm.conftest import frame

FOLD = str.maketrans(simhash.UPPER, simhash.LOWER)


def chain(numbers):
    h = 42
    for n in numbers:
        h = xxhash.xxh64_intdigest(n.to_bytes(8, "little"), seed=h)
    return h


def plain(text):
    words = [xxhash.xxh64_intdigest(w.encode(), seed=42) for w in re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))]
    shingles = [chain(words[i : i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [chain(words)] if words else []
    ones = [sum(h >> b & 1 for h in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def likeness(a, b):
    return 1 - (a ^ b).bit_count() / 64


def check(rows, docs, order):
    texts = sorted(((r.doc_id, r.text or "") for r in docs), key=order)
    wanted = []
    for i, (doc_id, text) in enumerate(texts):
        following = texts[(i + 1) % len(texts)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        a, b, c = plain(text), plain(edited), plain(following)
        wanted.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), a, b, likeness(a, b), likeness(a, c)))
    got = [(r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint % 2**64, r.edited_fingerprint % 2**64, r.near_edited, r.near_next) for r in rows]
    assert sorted(map(repr, got)) == sorted(map(repr, wanted))


def by_id(row):
    return (row[0] is not None, row[0] or 0, row[1])


def test_odd_rows(odd):
    for parts in (None, 3):
        check(simhash.fingerprints(odd, parts=parts).collect(), odd.collect(), by_id)


def test_one_document_and_none(spark, empty):
    one = frame(spark, ["a b c d e f g h"])
    check(simhash.fingerprints(one).collect(), one.collect(), by_id)
    assert simhash.fingerprints(empty).collect() == []


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = simhash.fingerprints(docs).collect()
    check(rows, docs.collect(), by_id)
    assert sum(r.near_edited for r in rows) > sum(r.near_next for r in rows) + 0.1 * len(rows)


NUMBERS = st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=4)
FLIPS = st.lists(st.lists(st.integers(0, 63), max_size=5), min_size=1, max_size=6)


@examples(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(NUMBERS, FLIPS)
def test_the_search_finds_every_pair_within_the_radius(spark, numbers, flips):
    every = set(numbers)
    for n in numbers:
        for bits in flips:
            for b in bits:
                n ^= 1 << b
            every.add(n)
    signed = [(n - 2**64 if n >> 63 else n,) for n in every]
    df = spark.createDataFrame([*signed, *signed[:2], (None,)], "fingerprint long")
    for radius, blocks in ((3, 6), (1, 3)):
        got = {(r["query"] % 2**64, r.fingerprint % 2**64, r.distance) for r in simhash.within(df, df, radius, blocks).collect()}
        assert got == {(a, b, (a ^ b).bit_count()) for a in every for b in every if (a ^ b).bit_count() <= radius}
