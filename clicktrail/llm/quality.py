"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

Pairs of a good and a bad labelled document say which one is preferred; logistic loss on the difference of their
features gives every feature value a weight. The cut between good and bad is a quantile of the labelled scores.

Every labelled document takes part: bin edges and the cut are exact order statistics of all of them, and weights are the
mean of those that balanced shares of them teach, side by side.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.sources.scratch import written

SCORED = "doc_id long, score double"
BROADCAST_LABELS = 500_000
"""So many labels are broadcast to the texts; of more, the features of all texts are shuffled to them."""
DIGIT = 11
"""Order statistics are found by so many bits of the values at a time."""
_WORD = re.compile(r"\S+")
_LETTER_RUN = re.compile(r"[^\W\d_]+")


def _share(part: float, whole: float) -> float:
    return part / whole if whole else 0.0


def features(text: str) -> list[float]:
    """Shape and repetition of a whole text; an empty text has zeros throughout."""
    words = _WORD.findall(text)
    lines = [x for x in (line.strip() for line in text.split("\n")) if x]
    runs = _LETTER_RUN.findall(text)
    n, w = len(text), len(words)
    letters = sum(map(len, runs))
    upper = sum(map(str.isupper, text))
    digits = sum(map(str.isdigit, text))
    spaces = sum(map(str.isspace, text))
    folded = [x.lower() for x in runs]
    counts = Counter(folded)
    triples = set(zip(folded, folded[1:], folded[2:], strict=False))
    starts = Counter(line.split(None, 1)[0] for line in lines)
    sizes = [len(x) for x in runs]
    raw = text.encode("utf-8")
    return [
        math.log1p(n),
        math.log1p(w),
        math.log1p(len(lines)),
        _share(letters, w),
        _share(sum(s * s for s in sizes), letters),
        _share(sum(s <= 3 for s in sizes), len(sizes)),
        _share(sum(s >= 10 for s in sizes), len(sizes)),
        _share(len(counts), len(folded)),
        _share(max(counts.values(), default=0), len(folded)),
        1 - _share(len(triples), max(len(folded) - 2, 0)),
        1 - _share(len(set(lines)), len(lines)),
        _share(max(starts.values(), default=0), len(lines)),
        _share(w, len(lines)),
        _share(upper, letters),
        _share(sum(x.isupper() for x in runs), len(runs)),
        _share(sum(x.istitle() for x in runs), len(runs)),
        _share(digits, n),
        _share(spaces, n),
        _share(n - letters - digits - spaces, n),
        _share(sum(map(text.count, ".?")), w),
        _share(text.count(","), w),
        _share(text.count("!"), w),
        _share(text.count("|"), w),
        _share(sum(map(text.count, "#$%&*@^~=+<>{}[]\\")), w),
        _share(len(runs), w),
        _share(len(zlib.compress(raw, 1)), len(raw)),
        _share(sum(line[-1] in ".!?" for line in lines), len(lines)),
        _share(sum(len(line) < 40 for line in lines), len(lines)),
    ]


@dataclass
class Ranking:
    """Weights of the feature bins, and where the cut lies: ``score`` is ``cut_score`` at the raw score ``cut``."""

    edges: list[np.ndarray]
    weights: np.ndarray
    cut: float
    cut_score: float

    def bins(self, rows: np.ndarray) -> np.ndarray:
        """For each row, the place of each feature's bin among the weights."""
        base = np.cumsum([0, *(len(e) + 1 for e in self.edges)])[:-1]
        return np.stack([np.searchsorted(e, rows[:, i], side="right") + b for i, (e, b) in enumerate(zip(self.edges, base, strict=True))], axis=1)

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.weights[self.bins(rows)].sum(axis=1)

    def score(self, rows: np.ndarray) -> np.ndarray:
        shift = math.log(self.cut_score / (1 - self.cut_score))
        return 1 / (1 + np.exp(-np.clip(self.raw(rows) - self.cut + shift, -500, 500)))


def rank(rows: np.ndarray, good: np.ndarray, cut_score: float = 0.5, bins: int = 12, pairs: int = 200_000, steps: int = 400, ridge: float = 1e-4, edges: list[np.ndarray] | None = None) -> Ranking:
    """Learn weights from preference pairs of good and bad rows, then cut at the quantile of the bad rows' share.

    Pairs go round robin through shuffled goods and bads (fixed seed), so that every row takes part in as many as any
    other of its kind; Adam minimises the mean logistic loss over all pairs at once.
    """
    if edges is None:
        edges = [np.unique(np.quantile(rows[:, i], np.linspace(0, 1, bins + 1)[1:-1])) for i in range(rows.shape[1])]
    model = Ranking(edges, np.zeros(sum(len(e) + 1 for e in edges)), 0.0, cut_score)
    places = model.bins(rows)
    g, b = np.flatnonzero(good), np.flatnonzero(~good)
    if not len(g) or not len(b):
        raise ValueError("both good and bad examples are needed")
    draw = np.random.default_rng(11)
    n = min(pairs, len(g) * len(b))
    better, worse = (np.concatenate([draw.permutation(x) for _ in range(-(-n // len(x)))])[:n] for x in (g, b))
    first = second = np.zeros_like(model.weights)
    size = len(model.weights)
    for step in range(1, steps + 1):
        margin = model.weights[places].sum(axis=1)
        pull = 1 / (1 + np.exp(np.clip(margin[better] - margin[worse], -50, 50))) / n
        per_row = np.bincount(better, pull, len(rows)) - np.bincount(worse, pull, len(rows))
        slope = ridge * model.weights - np.bincount(places.ravel(), np.repeat(per_row, places.shape[1]), size)
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        model.weights = model.weights - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
    model.cut = float(np.quantile(model.raw(rows), _share(len(b), len(rows))))
    return model


def _matrix(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return pc.list_flatten(values).to_numpy().reshape(len(values), -1)


def _features_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id or label, values) of rows (doc_id or label, text)."""
    for batch in batches:
        rows = [features(t.as_py() or "") for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], [batch.schema.names[0], "values"])


def _keys(values: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the numbers."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63) == 1, ~bits, bits | np.uint64(1 << 63))


def _number(key: int) -> float:
    bits = key ^ (1 << 63) if key >> 63 else key ^ ((1 << 64) - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _heads(among: list[np.ndarray] | None, known: int, shift: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of each column and label by the bits of the key from ``shift`` on; only where those from ``known`` on are among the given ones."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, labels, n = _keys(_matrix(batch.column("values"))), batch.column("label").to_numpy(), batch.column("n").to_numpy()
            for i in range(keys.shape[1]):
                for y in (0, 1):
                    of = labels == y
                    if among is not None:
                        of &= np.isin(keys[:, i] >> np.uint64(known), among[i])
                    heads, at = np.unique(keys[of, i] >> np.uint64(shift), return_inverse=True)
                    sums = np.zeros(len(heads), np.int64)
                    np.add.at(sums, at, n[of])
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(heads), i), pa.int32()), pa.array(heads.view(np.int64)), pa.array(np.full(len(heads), y), pa.int32()), pa.array(sums)], ["column", "head", "label", "n"])

    return count


def _least_reaching(rows: DataFrame, targets: list[list[int]], weights: tuple[int, int] = (1, 1)) -> list[list[float]]:
    """For each column of rows (label, values, n) and each of its targets the least value at which the weight of all
    values up to it reaches the target; a row weighs ``n`` times the weight of its label.

    Exact, by ``DIGIT`` bits of the values at a time: what comes to the driver is bounded by columns, targets and digits.
    """
    below, heads, known = [[0] * len(t) for t in targets], [[0] * len(t) for t in targets], 64
    while known:
        shift = max(0, known - DIGIT)
        among = None if known == 64 else [np.unique(np.array(h, np.uint64)) for h in heads]
        met = rows.mapInArrow(_heads(among, known, shift), "column int, head long, label int, n long").groupBy("column", "head", "label").agg(F.sum("n").alias("n")).toArrow()
        found: list[dict[int, int]] = [{} for _ in targets]
        for i, head, label, n in zip(*(met.column(c).to_pylist() for c in ("column", "head", "label", "n")), strict=True):
            head %= 1 << 64
            found[i][head] = found[i].get(head, 0) + n * weights[label]
        for i, column in enumerate(targets):
            ordered = sorted(found[i])
            for t, target in enumerate(column):
                inside = [h for h in ordered if known == 64 or h >> (known - shift) == heads[i][t]]
                for head in inside:
                    if below[i][t] + found[i][head] >= target or head == inside[-1]:
                        heads[i][t] = head
                        break
                    below[i][t] += found[i][head]
        known = shift
    return [[_number(h) for h in column] for column in heads]


def _edges(rows: DataFrame, size: int, columns: int, bins: int = 12) -> list[np.ndarray]:
    """The quantiles of ``rank`` of each column of rows (label, values, n), ``size`` rows with their copies."""
    at = (size - 1) * np.linspace(0, 1, bins + 1)[1:-1]
    lower = np.floor(at).astype(int)
    upper = np.minimum(lower + 1, size - 1)
    share, out = at - lower, []
    for found in _least_reaching(rows, [[*(lower + 1).tolist(), *(upper + 1).tolist()]] * columns):
        a, b = np.array(found[: len(at)]), np.array(found[len(at) :])
        out.append(np.unique(np.where(share >= 0.5, b - (b - a) * (1 - share), a + (b - a) * share)))
    return out


def _taught(table: pa.Table, edges: list[np.ndarray], cut_score: float, pairs: int) -> Ranking:
    """What rows (label, values, n) teach, whatever order they come in."""
    rows, label = _matrix(table.column("values")), table.column("label").to_numpy()
    order = np.lexsort((*rows.T[::-1], label))
    order = np.repeat(order, table.column("n").to_numpy()[order])
    return rank(rows[order], label[order] == 1, cut_score, pairs=pairs, edges=edges)


def _dealt(examples: DataFrame, shares: list[int], most: int) -> DataFrame:
    """Rows (label, values, n) dealt by hash into shares of each label, and these to as many blocks as the label with more
    shares has; the other label's go round robin. Of equal rows, at most ``most`` stay together."""
    piece = F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / most).cast("int") - 1))
    dealt = examples.select("*", piece.alias("piece")).withColumn("n", F.least(F.lit(most).cast("long"), F.col("n") - F.col("piece") * most))
    of = F.when(F.col("label") == 1, shares[1]).otherwise(shares[0])
    first = F.pmod(F.xxhash64("values", "piece"), of).cast("int")
    return dealt.select("label", "values", "n", F.explode(F.sequence(first, F.lit(max(shares) - 1), of)).alias("block"))


def train(docs: DataFrame, labels: DataFrame, cut_score: float = 0.5, share_rows: int = 20_000, pairs: int = 200_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Ranking | None:
    """Fit on all labelled documents. Weights are the mean of those that shares of them teach: some ``share_rows`` rows, half
    of each label, and at most ``pairs`` preference pairs of these, in which every row takes part as often as any other
    of its kind. Every document is in a share; those of the rarer label are in several, so that shares are balanced.

    Bin edges are quantiles of all of them, and so is the cut, at the bad ones' share of all labels. What comes to the
    driver are counts, the weights of each share, and the rows themselves only where there is one share. Rows without a
    label or a document are left out; None where one of the two labels has no document.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").distinct()
    given = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if sum(given.values()) <= BROADCAST_LABELS:
        measured = texts.join(F.broadcast(known), "doc_id").select("label", "text").mapInArrow(_features_of, "label int, values array<double>")
    else:
        kind = texts.schema["doc_id"].dataType.simpleString()
        measured = texts.mapInArrow(_features_of, f"doc_id {kind}, values array<double>").join(known, "doc_id").select("label", "values")
    examples = written(measured.groupBy("label", "values").agg(F.count("*").alias("n")), "quality-examples")
    met = {r.label: r.n for r in examples.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if len(met) < 2:
        return None
    edges = _edges(examples, sum(met.values()), len(features("")))
    shares = [-(-met[y] // (share_rows // 2)) for y in (0, 1)]
    if max(shares) == 1:
        model = _taught(examples.toArrow(), edges, cut_score, pairs)
    else:

        def learn(table: pa.Table) -> pa.Table:
            return pa.table({"block": table.column("block")[:1], "weights": pa.array([_taught(table, edges, cut_score, pairs).weights.tolist()], pa.list_(pa.float64()))})

        blocks = _dealt(examples, shares, max(1, share_rows // 200)).repartition(max(shares), "block")
        taught = blocks.groupBy("block").applyInArrow(learn, "block int, weights array<double>").toArrow().sort_by("block")
        model = Ranking(edges, _matrix(taught.column("weights")).mean(axis=0), 0.0, cut_score)
    # Rows weigh as much as their label has of all labels; in whole numbers, so that sums are exact.
    bad, good = given[0], given[1]
    model.cut = _least_reaching(_raw(examples, model), [[bad * met[0] * met[1]]], (bad * met[1], good * met[0]))[0][0]
    return model


def _raw(examples: DataFrame, model: Ranking) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = model.raw(_matrix(batch.column("values"))).reshape(-1, 1).tolist() if len(batch) else []
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(raw, pa.list_(pa.float64())), batch.column("n")], ["label", "values", "n"])

    return written(examples.mapInArrow(run, "label int, values array<double>, n long"), "quality-raw")


def score(docs: DataFrame, model: Ranking | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text: 0 to 1, higher is better. A null text counts as empty; null and repeated ids
    are rows like any other; without a model every score is 0.5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(t.as_py() or "") for t in batch.column(1)]).reshape(len(batch), -1)
            scores = np.full(len(batch), 0.5) if model is None or not len(batch) else model.score(rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], ["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCORED)


def keep(docs: DataFrame, model: Ranking | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of documents that score at least ``least``, with all their columns; without a model, all rows."""
    if model is None:
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([features(t.as_py() or "") for t in batch.column(text_col)]).reshape(len(batch), -1)
            yield batch.filter(pa.array(model.score(rows) >= least if len(batch) else [], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
