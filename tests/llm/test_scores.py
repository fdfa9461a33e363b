"""Toxicity and quality: exact search, learned weights, held-out labels, and rows out of the ordinary."""

import dataclasses
import math
import pickle
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clicktrail.llm import quality, toxicity
from clicktrail.llm.queries import held_out
from tests.llm.conftest import frame


def accuracy(scored, labels, column, cut):
    met = scored.join(labels, "doc_id").filter(held_out())
    return met.agg(F.avg(((F.col("score") >= cut) == (F.col(column) == 1)).cast("int"))).first()[0]


def test_the_index_finds_the_nearest_exactly():
    draw = np.random.default_rng(2)
    terms, n = 30, 400
    vectors = []
    for _ in range(n):
        chosen = draw.choice(terms, draw.integers(0, 6), replace=False)
        raw = draw.random(len(chosen)) + 0.1
        vectors.append({int(t): float(x) for t, x in zip(chosen, raw / (np.sqrt((raw**2).sum()) or 1), strict=True)})
    index = toxicity.BlockMaxIndex.build(vectors, list(range(n)), [i % 2 for i in range(n)], {str(t): t for t in range(terms)}, np.ones(terms), size=16)
    assert index.dense > terms
    dense = np.zeros((n, terms))
    for place, i in enumerate(index.ids):
        for t, x in vectors[int(i)].items():
            dense[place, t] = x
    for i in range(0, n, 7):
        query = vectors[i]
        q = np.zeros(terms)
        q[list(query)] = list(query.values())
        cosines = dense @ q
        for k, skip in ((1, None), (5, None), (15, 3), (500, None)):
            got_places, got = index.nearest(query, k, skip)
            allowed = np.array([p for p in np.flatnonzero(cosines > 1e-12) if p != skip], dtype=int)
            assert np.allclose(np.sort(got)[::-1], np.sort(cosines[allowed])[::-1][:k])
            assert np.allclose(cosines[got_places], got)
    # The same whether few or all terms are laid out as a matrix.
    few = dataclasses.replace(index, dense=3, _parts=None)
    for one, two in zip(index.nearest_of(vectors, 7), few.nearest_of(vectors, 7), strict=True):
        assert np.allclose(one[1], two[1])


def test_only_examples_of_opened_blocks_are_ranked(monkeypatch):
    """The k-th cosine is sought among the blocks opened first, not among all examples of every text."""
    draw = np.random.default_rng(3)
    raw = draw.random((400, 12)) * (draw.random((400, 12)) < 0.4)
    vectors = [{int(t): float(row[t] / np.linalg.norm(row)) for t in np.flatnonzero(row)} for row in raw]
    index = toxicity.BlockMaxIndex.build(vectors, list(range(400)), [i % 2 for i in range(400)], {str(t): t for t in range(12)}, np.ones(12), size=16)
    ranked, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda x, *a, **k: ranked.append(x.shape[-1]) or partition(x, *a, **k))
    index.nearest_of(vectors[:50], 7)
    assert ranked and max(ranked) < 200


def test_keys_are_found_as_by_their_order():
    known = toxicity.Terms([f"{a}{b}{end}" for a in "abcdefghij" for b in ("word", "längst", "слово") for end in ("", "*", "*2", "*4")])
    keys = np.concatenate([known._sorted, known._sorted[:-1] + np.uint64(4), np.array([0, 2**63, 2**64 - 1], np.uint64)])
    expected = [{int(k): int(p) for k, p in zip(known._sorted, known._order, strict=True)}.get(int(x), -1) for x in keys]
    assert known.find(keys).tolist() == expected
    assert toxicity.Terms([]).find(keys).tolist() == [-1] * len(keys)


def test_texts_are_read_as_their_terms_say(documents):
    """Pieces between blanks, remembered or forgotten, give the terms and counts of the whole text."""
    texts = [t or "" for t in documents.toPandas()["text"][:300]] + ["", " . ", "Über-Wörter über wörter,wörter;WÖRTER İstanbul ßtraßenbahn", "a1b2c3 x\x1cy\u2003zebra zebra zebrafish"]
    every = sorted({t for x in texts[::2] for t in toxicity.terms(x)})
    for limit in (10**6, 50):
        reader = toxicity.Reader(toxicity.Terms(every), limit)
        for text in texts:
            wanted = toxicity.terms(text)
            place, counts = reader.read(text)
            assert len(set(place.tolist())) == len(place) == len(wanted)
            got = dict(zip(place.tolist(), counts.tolist(), strict=True))
            assert all(got.pop(reader._known[t]) == n for t, n in wanted.items() if t in reader._known)
            assert sorted(got.values()) == sorted(float(n) for t, n in wanted.items() if t not in reader._known)
            assert all(p >= reader.size for p in got)


def test_many_texts_are_read_together(documents, monkeypatch):
    """Short texts are hashed side by side, as many as fit a stretch, and read as each alone."""
    texts = [t or "" for t in documents.toPandas()["text"][:100]] + ["", "", " . ", "\U00010400bcdefgh wordsworth", "Word words, words; WORDS wordy", "ΑΣ", "Σ", "long words " * 2_000, "a"]
    known = toxicity.Terms(sorted({t for x in texts[::2] for t in toxicity.terms(x)}))
    made, hashes = [], toxicity.Hashes
    monkeypatch.setattr(toxicity, "Hashes", lambda text: made.append(text) or hashes(text))
    for stretch, most in ((50, 10**6), (50_000, 30)):
        reader = toxicity.Reader(known, stretch)
        alone = [reader.read(t) for t in texts]
        made.clear()
        got = [(place[a:z], counts[a:z]) for place, counts, cuts in reader.read_all(texts) for a, z in zip(cuts, cuts[1:], strict=False)]
        assert len(made) < most
        assert len(got) == len(alone)
        for (place, counts), (wanted, met) in zip(got, alone, strict=True):
            assert (np.where(place < reader.size, place, -1) == np.where(wanted < reader.size, wanted, -1)).all()
            assert (counts == met).all() and len(set(place.tolist())) == len(place)


def test_terms_that_a_family_shares_are_added_up_by_matrix(monkeypatch):
    """Eight languages without a common word: one of 32 examples has a word, a quarter of those of its language."""
    draw = np.random.default_rng(7)
    languages, each, words = 8, 64, 40
    vectors, ids = [], []
    for i in range(languages * each):
        chosen = draw.choice(words, 10, replace=False) + words * (i % languages)
        raw = draw.random(10) + 0.1
        vectors.append({int(t): float(x) for t, x in zip(chosen, raw / np.linalg.norm(raw), strict=True)})
        ids.append(1_000 + i)
    terms = languages * words
    index = toxicity.BlockMaxIndex.build(vectors, ids, [i // 8 % 2 for i in range(len(ids))], {str(t): t for t in range(terms)}, np.ones(terms), size=16)
    assert index.families[-1] == 32 and len(index.families) == languages
    table = np.zeros((len(ids), terms))
    for i, v in enumerate(vectors):
        table[i, list(v)] = list(v.values())
    index.nearest_of(vectors[:1], 5)
    added, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *a, **k: added.append(len(x)) or bincount(x, *a, **k))
    found = index.nearest_of(vectors, 5)
    monkeypatch.undo()
    postings = sum(int((table[:, list(v)] > 0).sum()) for v in vectors)
    assert sum(added) < postings / 10
    for i, (places, cosines) in enumerate(found):
        assert np.allclose(cosines, np.sort(table @ table[i])[::-1][:5])
        assert np.allclose(table[index.ids[places] - 1_000] @ table[i], cosines)


def test_a_task_keeps_what_searching_needs_only():
    draw = np.random.default_rng(9)
    vectors = [{int(t): float(x) for t, x in zip(draw.choice(90, 5, replace=False), draw.random(5) + 0.1, strict=True)} for _ in range(200)]
    index = toxicity.BlockMaxIndex.build(vectors, list(range(200)), [i % 2 for i in range(200)], {str(t): t for t in range(90)}, np.ones(90), size=16)
    task = pickle.loads(pickle.dumps(index))
    for _ in range(2):
        task.only_search()
        assert not len(task.examples) and not len(task.weights)
        for one, two in zip(index.nearest_of(vectors, 7), task.nearest_of(vectors, 7), strict=True):
            assert (one[0] == two[0]).all() and (one[1] == two[1]).all()


def test_of_equal_cosines_the_smaller_rank_comes_first():
    """Copies stand in several blocks; without a label, they are taken by their ids."""
    vectors = [{0: 1.0}] * 100 + [{1: 0.6, 2: 0.8}] * 50
    index = toxicity.BlockMaxIndex.build(vectors, list(range(150)), [int(i % 3 == 0) for i in range(150)], {"a": 0, "b": 1, "c": 2}, np.ones(3), size=16)
    for query, members in (({0: 1.0}, range(100)), ({1: 1.0}, range(100, 150))):
        wanted = sorted(members, key=lambda i: (i % 3 == 0, i))[:40]
        assert index.ids[index.nearest(query, 40)[0]].tolist() == wanted


def test_whole_scores_by_brute_force(spark, documents, labels):
    """Every step again in plain Python: document frequencies, correlation, cosines, votes and the calibrated curve."""
    model = toxicity.train(documents, labels.filter(~held_out()), max_examples=200)
    rows = documents.select("doc_id", "text").collect()
    texts = {r.doc_id: r.text or "" for r in rows}
    index = model.index
    examples = dict(zip(index.ids.tolist(), index.labels.tolist(), strict=True))
    assert len(examples) == len(index.ids) and all(examples[r.doc_id] == r.toxic for r in labels.collect() if r.doc_id in examples)
    every = {i: toxicity.terms(t) for i, t in texts.items()}
    frequency = Counter(t for c in every.values() for t in c)
    positive = Counter(t for i, y in examples.items() if y for t in every[i])
    with_term = Counter(t for i in examples for t in every[i])
    n, pos = len(examples), sum(examples.values())
    neg = n - pos

    def idf(t):
        if t not in with_term:
            return (math.log((1 + len(texts)) / 2) + 1) * math.sqrt(1 / (n + 1))
        a, m = positive[t], with_term[t]
        chi = n * (a * neg - (m - a) * pos) ** 2 / (m * (n - m + 0.5) * pos * neg)
        return (math.log((1 + len(texts)) / (1 + frequency[t])) + 1) * math.sqrt((chi + 1) / (n + 1))

    def unit(counts):
        raw = {t: (1 + math.log(c)) * idf(t) for t, c in counts.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        return {t: x / norm for t, x in raw.items()}

    vectors = {i: unit(every[i]) for i in examples}
    assert list(index.vocabulary) == sorted(with_term)
    scored = {r.doc_id: r for r in toxicity.score(documents, model).collect()}
    for i in list(texts)[::9]:
        q = unit(every[i]) if every[i] else {}
        if not any(t in with_term for t in q):
            assert scored[i].score == pytest.approx(model.unknown) and not scored[i].evidence
            continue
        cosines = sorted(((sum(x * v.get(t, 0.0) for t, x in q.items()), j) for j, v in vectors.items()), reverse=True)[: model.k]
        weight = sum(c * c for c, _ in cosines)
        vote = (sum(c * c * examples[j] for c, j in cosines) + 0.1 * model.prior) / (weight + 0.1)
        assert scored[i].score == pytest.approx(1 / (1 + math.exp(-(model.slope * vote + model.shift))), abs=1e-9)
        assert [e.cosine for e in scored[i].evidence] == pytest.approx([c for c, _ in cosines[:3]], abs=1e-9)


def test_toxicity_of_held_out_documents(documents, labels):
    model = toxicity.train(documents, labels.filter(~held_out()))
    assert accuracy(toxicity.score(documents, model), labels, "toxic", 0.5) > 0.9
    assert toxicity.score(documents, model).filter("score < 0 or score > 1 or score is null").count() == 0


def test_quality_of_held_out_documents(documents, labels):
    model = quality.train(documents, labels.filter(~held_out()), cut_score=0.3)
    assert accuracy(quality.score(documents, model), labels, "quality", 0.3) > 0.9
    kept = {r.doc_id for r in quality.keep(documents, model, 0.3).collect()}
    assert kept == {r.doc_id for r in quality.score(documents, model).filter("score >= 0.3").collect()}


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_odd_rows(spark, operator, documents, labels, odd, empty):
    model = operator.train(documents, labels)
    rows = operator.score(odd, model).collect()
    assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(r.doc_id) for r in odd.collect())
    assert all(0 <= r.score <= 1 for r in rows)
    scores = {r.doc_id: r.score for r in rows}
    assert scores[0] == scores[1] and scores[5] == scores[6]
    assert operator.keep(odd, model, 0.5).columns == odd.columns
    assert operator.score(empty, model).collect() == [] == operator.keep(empty, model, 0.5).collect()
    # Nothing to learn from: no labels, one kind of label, labels of no document, null labels.
    kind = "doc_id long, toxic int, quality int"
    for given in ([], [(0, 1, 1), (3, 1, 1)], [(10**9, 1, 1), (10**9 + 1, 0, 0)], [(3, None, None), (None, 1, 0)]):
        assert operator.train(odd, spark.createDataFrame(given, kind)) is None
    assert {r.score for r in operator.score(odd, None).collect()} == {0.0 if operator is toxicity else 0.5}
    assert operator.keep(odd, None, 0.5).count() == odd.count()


def test_pairs_teach_the_order():
    draw = np.random.default_rng(3)
    rows = draw.normal(size=(600, 4))
    good = rows[:, 1] - rows[:, 2] ** 2 + 0.1 * draw.normal(size=600) > -1
    model = quality.rank(rows, good)
    raw = model.raw(rows)
    assert (raw[good][:, None] > raw[~good][None, :]).mean() > 0.97
    assert ((model.score(rows) >= 0.5) == (raw >= model.cut)).all()
    assert abs((raw < model.cut).mean() - (~good).mean()) < 0.01


def test_rare_toxic_words_count(spark):
    """Each toxic word stands in ten toxic examples only, beside words that both labels use alike."""
    draw = np.random.default_rng(5)
    bad = [f"{a}{b}" for a in ("quib", "zorl", "vext", "jamp", "wulk", "drof", "plim", "skag") for b in ("a", "e", "i", "o", "u")]

    def text(*extra):
        return " ".join(draw.permutation([*(f"{x}" for x in draw.choice(["one", "two", "red", "sea", "sun", "day", "owl", "ice"], 12)), *extra]))

    toxic = [text(w, *(["vile"] if i % 4 == 0 else [])) for w in bad for i in range(10)]
    examples = toxic + [text() for _ in toxic]
    asked = [text(w) for w in bad] + [text() for _ in bad]
    docs = frame(spark, examples + asked)
    labels = spark.createDataFrame([(i, int(i < len(toxic))) for i in range(len(examples))], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert set(bad) < set(model.index.vocabulary) and {"one", "ice"} < set(model.index.vocabulary) and (model.index.idf > 0).all()
    rows = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    right = [(rows[len(examples) + i].score >= 0.5) == (i < len(bad)) for i in range(len(asked))]
    assert sum(right) > 0.95 * len(right)
    assert all(r.evidence for r in rows.values())
    known, more = model.index.vector("one quiba"), model.index.vector("one quiba nowhere")
    assert (known[0] == more[0]).all() and (more[1] < known[1]).all()


def test_the_number_of_pairs_can_be_given(documents, labels, monkeypatch):
    met, rank = [], quality.rank
    monkeypatch.setattr(quality, "rank", lambda *a, **b: met.append(b["pairs"]) or rank(*a, **b))
    few, all_of = (quality.train(documents, labels, pairs=n) for n in (20, 10**6))
    assert met == [20, 10**6] and (few.weights != all_of.weights).any()


def test_quality_learns_from_every_labelled_document(documents, labels, monkeypatch):
    """Few rows to a share: edges, cut and weights come from all rows all the same, with labels broadcast or not."""
    given = labels.filter(~held_out())
    model = quality.train(documents, given, 0.3, 60)
    rows = documents.join(given, "doc_id").filter("quality in (0, 1)").select("quality", "text").collect()
    values, good = np.array([quality.features(r.text or "") for r in rows]), np.array([r.quality == 1 for r in rows])
    for i, edges in enumerate(model.edges):
        assert edges.tolist() == np.unique(np.quantile(values[:, i], np.linspace(0, 1, 13)[1:-1])).tolist()
    raw = np.sort(model.raw(values))
    assert model.cut == raw[max(0, (~good).sum() - 1)]
    assert accuracy(quality.score(documents, model), labels, "quality", 0.3) > 0.9
    monkeypatch.setattr(quality, "BROADCAST_LABELS", 0)
    assert (quality.train(documents.repartition(3), given.repartition(5), 0.3, 60).weights == model.weights).all()


def test_shares_hold_every_row_and_both_labels(spark):
    """Copies are spread, the rarer label goes to every block, and each block has all of its share."""
    rows = [(1, [float(i)], 1) for i in range(900)] + [(1, [-1.0], 1000)] + [(0, [float(i)], 2) for i in range(40)]
    examples = spark.createDataFrame(rows, "label int, values array<double>, n long")
    blocks = quality._dealt(examples, [1, 4], 50).collect()
    assert {b.block for b in blocks} == set(range(4))
    good = Counter()
    for b in blocks:
        good[b["values"][0]] += b.n if b.label else 0
    assert all(good[float(i)] == 1 for i in range(40, 900)) and good[-1.0] == 1000
    assert all(sum(b.n for b in blocks if b.block == k and not b.label) == 80 for k in range(4))
    assert all(0 < sum(b.n for b in blocks if b.block == k and b["values"] == [-1.0]) < 600 for k in range(4))


def test_order_statistics_are_exact(spark):
    draw = np.random.default_rng(8)
    values = np.concatenate([draw.normal(size=150), [0.0, -0.0, 1e300, -1e-300, 5e-324], np.repeat(draw.normal(size=10), 30)])
    labels = draw.integers(0, 2, len(values))
    rows = spark.createDataFrame([(int(y), [float(v), float(-v)], 1) for v, y in zip(values, labels, strict=True)], "label int, values array<double>, n long").repartition(4)
    both = quality._least_reaching(rows, [[1, 100, len(values)], [200]])
    assert both == [[np.sort(values)[k - 1] for k in (1, 100, len(values))], [np.sort(-values)[199]]]
    order = np.argsort(values, kind="stable")
    total = np.cumsum(np.where(labels[order] == 1, 3, 10**18).astype(object))
    assert quality._least_reaching(rows, [[10**20], []], (10**18, 3))[0] == [values[order][next(i for i, t in enumerate(total) if t >= 10**20)]]
