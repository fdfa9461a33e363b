"""The Jaccard join against all pairs."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import HealthCheck, given
from hypothesis import settings as examples
from hypothesis import strategies as st

from clicktrail.llm import jaccard
from tests.llm.conftest import frame

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def roots(n, links):
    lead = list(range(n))

    def top(x):
        while lead[x] != x:
            x = lead[x]
        return x

    for a, b in links:
        lead[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    root = roots(len(rows), links)
    names = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    return sorted(repr((rows[i][0], len(sets[i]), names[root[i]])) for i in range(len(rows)))


def check(df, **options):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(repr(tuple(r)) for r in jaccard.join(df, **options).collect()) == plain(rows)


def made(seed, n=140):
    """Families of near copies at all distances, a passage and a line that many share, and exact copies."""
    draw = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = " ".join(draw.choice(vocabulary, 60))
    texts = []
    while len(texts) < n:
        words = list(draw.choice(vocabulary, draw.integers(3, 80)))
        for _ in range(draw.integers(1, 25)):
            copy = list(words)
            for _ in range(draw.integers(0, 6)):
                copy[draw.integers(len(copy))] = str(draw.choice(vocabulary))
            texts.append(" ".join(copy) + (f" {passage}" if draw.random() < 0.3 else "") + (" the same last line here now" if draw.random() < 0.5 else ""))
    return texts + texts[:20]


def test_near_copies_of_all_kinds(spark):
    for seed, band in ((1, 256), (2, 8)):
        check(frame(spark, made(seed)), band=band)


def test_odd_rows_and_empty_table(odd, empty):
    check(odd)
    assert jaccard.join(empty).collect() == []


def test_a_hot_group(spark):
    words = [f"w{i}" for i in range(40)]
    near = [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in range(40)]
    check(frame(spark, [" ".join(words)] * 60 + near + [f"no{i} relation{i} to{i} any{i} of{i} them{i}" for i in range(80)]), band=16)


@examples(max_examples=100, deadline=None)
@given(st.integers(0, 300), st.integers(0, 300), st.integers(0, 300), st.integers(0, 2**32))
def test_no_linked_pair_is_ruled_out(shared, a, b, seed):
    draw = np.random.default_rng(seed)
    all_of = np.unique(draw.integers(0, 2**63, shared + a + b + 10, dtype=np.uint64))
    x, y = np.sort(all_of[: shared + a]), np.sort(np.concatenate([all_of[:shared], all_of[shared + a : shared + a + b]]))
    if not len(x) or not len(y):
        return
    maybe, _ = jaccard._possible(np.array([len(x), len(y)]), [jaccard._bitmap(x), jaccard._bitmap(y)], np.array([0]), np.array([1]), 75)
    if jaccard._linked(x, y, 75):
        assert len(maybe)
        hot = np.sort(all_of[::3])
        for frequent in (np.zeros(0, np.uint64), hot):
            assert set(jaccard._first(x, frequent, 75).tolist()) & set(jaccard._first(y, frequent, 75).tolist())


def test_words_are_the_same_in_pieces(monkeypatch):
    text = ("Ab\tcd  é😀\n" * 500).encode() + b"x" * 5000 + b" end"
    whole = jaccard.word_hashes(text)
    assert len(whole) == len(re.findall(r"[^\x20\x09-\x0D]+", text.decode()))
    assert len(np.unique(whole)) == 5
    assert (jaccard.word_hashes(text.lower()) == whole).all()
    monkeypatch.setattr(jaccard, "PIECE", 64)
    jaccard._powers.cache_clear()
    cut = jaccard.word_hashes(text)
    jaccard._powers.cache_clear()
    assert (cut[:-2] == whole[:-2]).all() and cut[-1] == whole[-1]


def test_words_before_a_huge_one_keep_their_hashes():
    """Hashes depend on the word alone, so a text that ends in a huge word still shares what stands before it."""
    words = " ".join(f"word{i}" for i in range(1000))
    for size in (jaccard.PIECE - 1, jaccard.PIECE, jaccard.PIECE + 1, 2 * jaccard.PIECE + 200_000):
        huge = b"x" * size
        alone, before = jaccard.word_hashes(huge), jaccard.word_hashes(words.encode() + b" " + huge + b" end")
        assert (before[:1000] == jaccard.word_hashes(words.encode())).all()
        assert before[1000] == alone[0] and len(before) == 1002
    a, b = (jaccard.shingle_set(f"{words} {'x' * n}") for n in (2_200_000, 10_000))
    assert len(np.intersect1d(a, b)) == 996 and len(a) == len(b) == 997


@examples(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, links):
    df = spark.createDataFrame(links, "a int, b int")
    got = {r.node: r.component for r in jaccard.components(df).collect()}
    root = roots(31, links)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root[x] for x in nodes}


def test_a_long_chain_is_one_component(spark):
    df = spark.createDataFrame([(i, i + 1) for i in range(200)], "a int, b int")
    assert {r.component for r in jaccard.components(df).collect()} == {0}


def test_keep_one(spark, odd):
    docs = frame(spark, made(3, 60))
    linked = {r.doc_id: r.component_id for r in jaccard.join(docs).collect()}
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for c in linked.values()})
    ids = sorted(repr(r.doc_id) for r in jaccard.keep_one(odd).collect())
    assert ids.count("77") == 1 and ids.count("None") == 2 and "6" not in ids and "5" in ids


def test_texts_side_by_side_give_the_sets_of_each():
    texts = ["", " ", "one", "a b c d", "a b c d e", "A b\tc d E f", "e f", "x " * 70_000 + "end of it all", "", "a b c d e", "w" * 200_000, "ünï cödé wörds are fine too"]
    texts += [" ".join(f"w{i % 7}{i % 11}" for i in range(n)) for n in range(300)]
    together = list(jaccard.shingle_sets(texts))
    assert len(together) == len(texts)
    for text, found in zip(texts, together, strict=True):
        words = [w.lower() for w in re.split("[\x20\x09-\x0d]+", text) if w]
        wanted = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
        assert len(found) == len(wanted) and (np.diff(found.astype(object)) > 0).all()
        assert (found == jaccard.shingle_set(text)).all()


def test_links_that_are_stars_take_no_more_steps(spark, monkeypatch):
    """Every step is jobs and plans on the driver."""
    steps, written = [], jaccard.written
    monkeypatch.setattr(jaccard, "written", lambda df, what: steps.append(what) or written(df, what))
    df = spark.createDataFrame([(5, 1), (1, 7), (9, 1), (1, 9), (3, 4)], "a long, b long")
    assert {r.node: r.component for r in jaccard.components(df).collect()} == {1: 1, 5: 1, 7: 1, 9: 1, 3: 3, 4: 3}
    assert steps == ["links"]


def test_tiles_give_stars():
    """Links of a chain tie all of its classes, in a tile, to the smallest; each step that a chain needs is jobs and plans on the driver."""
    sets = [np.arange(i, i + 40, dtype=np.uint64) for i in range(30)]
    names = [(7 * i) % 30 + 5 for i in range(30)]
    columns = {"tile": [1] * 30, "i": [0] * 30, "j": [0] * 30, "class": names, "component": [x + 100 for x in names], "n": [40] * 30, "bitmap": [jaccard._bitmap(s) for s in sets], "shingles": [s.tobytes() for s in sets]}
    for apart in (False, True):
        found = [tuple(r.values()) for b in jaccard._forest(75, apart)(iter([pa.RecordBatch.from_pydict(columns)])) for r in b.to_pylist()]
        least = 105 if apart else 5
        assert sorted(found) == [(least, least + i) for i in range(1, 30)]
