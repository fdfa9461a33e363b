"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, and weighted votes.

The index holds a bounded number of labelled examples over all of their terms, and goes to every task. A term's IDF
is multiplied by its correlation with the label, so that rare toxic words outweigh what all texts of a language share;
no term has weight 0. Examples stand in blocks, those of one family (such as a language) together. The terms that many of
a family share are laid out as matrices and keep their largest weight in each block; with the exact sums over all other
terms these bound every cosine in a block from above, and blocks that can't reach the nearest ones found so far are never
opened.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.memory import give_back
from clicktrail.sources.scratch import written

SCORED = "doc_id long, score double, evidence array<struct<example: long, label: int, cosine: double>>"
Vector = dict[int, float] | tuple[np.ndarray, np.ndarray]
"""Weights by term, or terms and their weights side by side."""
_TERM = re.compile(r"[^\W\d_]+")
_GAP = re.compile(r"[\W\d_]")
_WHOLE_TERM = re.compile(r"[^\W\d_]+(\*[24]?)?")


TOGETHER = 512
"""Texts of a batch that are held as Python strings at a time; equal ones among them are worked out once."""


def _texts(column: pa.Array, start: int) -> list[str]:
    return [t or "" for t in column.slice(start, TOGETHER).to_pylist()]


def terms(text: str) -> dict[str, int]:
    """How often words in lower case and their beginnings of four to seven letters are met, and marks for beginnings met
    twice and four times."""
    words = Counter(_TERM.findall(text.lower()))
    starts: dict[str, int] = {}
    for w, n in words.items():
        for end in range(4, min(8, len(w))):
            s = w[:end] + "*"
            starts[s] = starts.get(s, 0) + n
    marks = {f"{s}{n}": 1 for n in (2, 4) for s, met in starts.items() if met >= n}
    return {**words, **starts, **marks}


_BASE = 0x9E3779B97F4A7C15
_BEGINNINGS = np.arange(4, 8)
_WORD, _START, _TWICE, _OFTEN = 0, 1, 2, 3
"""The last two bits of a term's key: a word, a beginning, and the marks of beginnings met twice and four times."""


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """By code point, whether ``_TERM`` takes it."""
    return np.array([c.isalnum() and not c.isdecimal() for c in map(chr, range(0x110000))])


def _mix(codes: np.ndarray) -> np.ndarray:
    mixed = (codes + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(29)
    return mixed


@lru_cache(maxsize=1)
def _mixed() -> np.ndarray:
    """The first 65,536 code points, mixed."""
    return _mix(np.arange(1 << 16, dtype=np.uint32))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2 ** 64."""
    inverse = pow(_BASE, -1, 1 << 64)
    return tuple(np.cumprod(np.append(np.uint64(1), np.full(n, x, np.uint64))) for x in (_BASE, inverse))


class Hashes:
    """Hashes of all runs of letters of a text: sums of mixed code points times powers of a base, so that any stretch of the
    text is the difference of two sums."""

    def __init__(self, text: str) -> None:
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = np.zeros(len(self.codes) + 2, bool)
        inside[1:-1] = _letters()[self.codes]
        self.begin, self.end = np.ascontiguousarray(np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2).T)
        mixed = _mixed()[self.codes] if self.codes.max(initial=0) < 1 << 16 else _mix(self.codes)
        power, self._inverse = _powers(max(1 << 16, 1 << len(text).bit_length()))
        mixed *= power[: len(mixed)]
        self._sums = np.zeros(len(mixed) + 1, np.uint64)
        np.cumsum(mixed, out=self._sums[1:])

    def keys(self, begin: np.ndarray, end: np.ndarray, kind: int | np.ndarray) -> np.ndarray:
        """Of each stretch: 62 bits of its hash, then its kind."""
        hashes = (self._sums[end] - self._sums[begin]) * self._inverse[begin]
        return hashes & np.uint64(2**64 - 4) | np.asarray(kind, np.uint64)

    def beginnings(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the beginnings of four to seven letters of all longer words, in the order of the words, and how many each word has."""
        sizes = self.end - self.begin
        long = np.flatnonzero(sizes > 4)
        begin = self.begin[long]
        has = sizes[long][:, None] > _BEGINNINGS
        sums = self._sums.take(begin[:, None] + _BEGINNINGS, mode="clip")
        sums -= self._sums[begin][:, None]
        sums *= self._inverse[begin][:, None]
        return sums[has] & np.uint64(2**64 - 4) | np.uint64(_START), np.clip(sizes - 4, 0, 4)


class Terms(Mapping):
    """Terms by place: one Arrow array, found by sorted keys, which are looked up from where those with the same first bits
    begin. Of two terms with one key the first would stand for both, which has odds of some 1e-7 with a million terms."""

    def __init__(self, terms: Iterable[str] | pa.Array) -> None:
        self._terms = terms if isinstance(terms, pa.Array) else pa.array(list(terms), pa.string())
        keys = np.concatenate([np.zeros(0, np.uint64), *(self._keys(self._terms.slice(a, 8_192).to_pylist()) for a in range(0, len(self), 8_192))])
        order = np.argsort(keys, kind="stable")
        # The last entry ends every search; no term stands there.
        self._sorted, self._order = np.append(keys[order], np.uint64(2**64 - 1)), np.append(order, -1).astype(np.int32)
        bits = max(1, len(keys).bit_length())
        self._shift = np.uint64(64 - bits)
        self._heads = np.searchsorted(self._sorted[:-1], np.arange(1 << bits, dtype=np.uint64) << self._shift).astype(np.int32)

    @staticmethod
    def _keys(terms: list[str]) -> np.ndarray:
        """Keys of words, beginnings (``*``) and marks (``*2``, ``*4``)."""
        made = Hashes("\n".join([*terms, ""]) + "\n")
        after, then = made.codes[made.end], made.codes[made.end + 1]
        kind = np.where(after != ord("*"), _WORD, np.select([then == ord("2"), then == ord("4")], [_TWICE, _OFTEN], _START))
        return made.keys(made.begin, made.end, kind)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the terms with these keys, -1 where there is none."""
        at = self._heads[keys >> self._shift]
        met = self._sorted[at]
        short = np.flatnonzero(met < keys)
        while len(short):
            at[short] += 1
            met[short] = now = self._sorted[at[short]]
            short = short[now < keys[short]]
        return np.where(met == keys, self._order[at], -1)

    def __getitem__(self, term: str) -> int:
        place = int(self.find(self._keys([term]))[0]) if _WHOLE_TERM.fullmatch(term) else -1
        if place < 0:
            raise KeyError(term)
        return place

    def __iter__(self) -> Iterator[str]:
        return (t.as_py() for t in self._terms)

    def __len__(self) -> int:
        return len(self._terms)


class Reader:
    """Texts to numbered terms and how often each is met, as ``terms`` has them, by keys in place of strings.

    Terms outside the vocabulary get numbers beyond it, as they count in norms. A text is read whole, in stretches of ``stretch``
    code points or more that end between words, which bounds what is held beside it and changes no result.
    """

    def __init__(self, vocabulary: Mapping[str, int], stretch: int = 50_000) -> None:
        self._known = vocabulary if isinstance(vocabulary, Terms) else Terms(vocabulary)
        self.size, self._stretch = len(self._known), stretch

    def _stretches(self, text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > self._stretch:
            gap = _GAP.search(text, start + self._stretch)
            if gap is None:
                break
            yield text[start : gap.start()]
            start = gap.start()
        yield text[start:]

    def _count(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys of words and beginnings of one text after the other, rising, how often each is met, and where each text begins."""
        made = Hashes("\n".join(texts))
        words, (starts, per_word) = made.keys(made.begin, made.end, _WORD), made.beginnings()
        word = np.append(0, np.searchsorted(made.begin, np.cumsum([len(t) + 1 for t in texts])))
        start = np.append(0, np.cumsum(per_word))[word]
        # Each text's words, then their beginnings; a text's own share is sorted.
        found, at = np.empty(len(words) + len(starts), np.uint64), word + start
        for a, b, c, d, e, f in zip(at.tolist(), at[1:].tolist(), word.tolist(), word[1:].tolist(), start.tolist(), start[1:].tolist(), strict=False):
            part, n = found[a:b], d - c
            part[:n], part[n:] = words[c:d], starts[e:f]
            part.sort()
        new = np.empty(len(found), bool)
        np.not_equal(found[1:], found[:-1], out=new[1:])
        new[at[:-1][at[:-1] < len(found)]] = True
        head = np.flatnonzero(new)
        return found[head], np.diff(head, append=len(found)), np.searchsorted(head, at)

    def _places(self, keys: np.ndarray, counts: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of each text's terms, those of marks last, counts, and where each text begins."""
        starts = np.flatnonzero(((keys & np.uint64(3)) == _START) & (counts >= 2))
        often = starts[counts[starts] >= 4]
        place = self._known.find(np.concatenate([keys, keys[starts] + np.uint64(_TWICE - _START), keys[often] + np.uint64(_OFTEN - _START)]))
        if len(cuts) > 2:
            of = [np.repeat(np.arange(len(cuts) - 1), np.diff(x)) for x in (cuts, np.searchsorted(starts, cuts), np.searchsorted(often, cuts))]
            of = np.concatenate(of)
            order = np.argsort(of, kind="stable")
            place, cuts = place[order], np.append(0, np.cumsum(np.bincount(of, minlength=len(cuts) - 1)))
            counts = np.append(counts, np.ones(len(place) - len(counts)))[order]
        else:
            counts, cuts = np.append(counts, np.ones(len(place) - len(counts))), np.array([0, len(place)])
        place = place.astype(np.int64)
        unknown = np.flatnonzero(place < 0)
        place[unknown] = self.size + np.arange(len(unknown))
        return place, counts, cuts

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct numbers, those of marks last, and counts; numbers from ``size`` on are outside the vocabulary."""
        parts = [self._count([x])[:2] for x in self._stretches(text.lower())]
        keys, counts = parts[0]
        if len(parts) > 1:
            keys, place = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([n for _, n in parts]))
        return self._places(keys, counts, np.array([0, len(keys)]))[:2]

    def read_all(self, texts: Sequence[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``read`` of many texts: numbers and counts of some of them, one after the other, and where each text begins."""
        some, room = [], self._stretch
        for text in map(str.lower, texts):
            if some and len(text) >= room:
                yield self._places(*self._count(some))
                some, room = [], self._stretch
            if len(text) > self._stretch:
                place, counts = self.read(text)
                yield place, counts, np.array([0, len(place)])
            else:
                some.append(text)
                room -= len(text) + 1
        if some:
            yield self._places(*self._count(some))


def _arrays(vector: Vector) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(vector, dict):
        return np.fromiter(vector.keys(), np.int64, len(vector)), np.fromiter(vector.values(), float, len(vector))
    return vector


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _families(starts: np.ndarray, examples: np.ndarray, weights: np.ndarray, n: int, most: int = 8, common: int = 1_024) -> np.ndarray:
    """Examples by likeness over the commonest terms (spherical k-means from far-off seeds), such as by language; it decides speed only."""
    chosen = np.argsort(starts[:-1] - starts[1:], kind="stable")[:common]
    met = starts[chosen + 1] - starts[chosen]
    rows, posting = np.zeros((n, len(chosen)), np.float32), _ranges(starts[chosen], met)
    rows[examples[posting], np.repeat(np.arange(len(chosen)), met)] = weights[posting]

    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)

    rows = unit(rows)
    seeds, near = [0], rows @ rows[0]
    while len(seeds) < min(most, n):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[seeds[-1]])
    centres = rows[seeds]
    for _ in range(6):
        family = (rows @ centres.T).argmax(axis=1)
        centres = unit(np.stack([rows[family == f].sum(axis=0) for f in range(len(centres))]))
    return family


SHARED = 8
"""A term is laid out in the matrix of a family where more than one of so many examples has it."""


@dataclass
class Shelf:
    """Matrix of one family: weights by block, place of each of its commonest terms and example, and the largest weights by
    place and block. ``first`` is the family's first block."""

    first: int
    weights: np.ndarray
    largest: np.ndarray


@dataclass
class BlockMaxIndex:
    """Postings by term, and blocks of ``size`` examples with the largest weight of each common term in each block.

    Term t has the postings ``starts[t]`` to ``starts[t + 1]``. ``unknown`` is the IDF of a term that no example
    has. ``families`` are where blocks of similar examples end. Up to ``dense`` terms that most examples of a family share are
    also laid out as its matrix by block, for many texts at a time. Of equal cosines the smaller ``rank`` comes first.
    """

    vocabulary: Mapping[str, int]
    idf: np.ndarray
    unknown: float
    ids: np.ndarray
    labels: np.ndarray
    rank: np.ndarray
    families: np.ndarray
    size: int
    starts: np.ndarray
    examples: np.ndarray
    weights: np.ndarray
    dense: int = 1_024
    _reader: Reader | None = field(default=None, repr=False)
    _parts: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[Shelf]] | None = field(default=None, repr=False)

    @classmethod
    def build(cls, vectors: Sequence[Vector], ids: Sequence[int], labels: Sequence[int], vocabulary: Mapping[str, int], idf: np.ndarray, size: int = 32, unknown: float = 0.0, dense: int = 1_024) -> BlockMaxIndex:
        """Examples of one family, and in it those with the same strongest term, stand together, which keeps the bounds tight."""
        pairs = [_arrays(v) for v in vectors]
        strongest = [(int(t[at]), float(w[at])) if len(t) and (at := np.lexsort((t, w))[-1]) >= 0 else (-1, 0.0) for t, w in pairs]
        order = sorted(range(len(ids)), key=lambda i: (labels[i], strongest[i][0], -strongest[i][1], ids[i]))
        lengths = [len(pairs[i][0]) for i in order]
        term = np.concatenate([np.zeros(0, np.int32), *(pairs[i][0].astype(np.int32) for i in order)])
        by_term = np.argsort(term, kind="stable").astype(np.int32)
        starts = np.searchsorted(term[by_term], np.arange(len(vocabulary) + 1)).astype(np.int32)
        del term
        examples = np.repeat(np.arange(len(order), dtype=np.int32), lengths)[by_term]
        weights = np.concatenate([np.zeros(0), *(pairs[i][1] for i in order)])[by_term]
        del pairs, by_term
        family = _families(starts, examples, weights, len(order))
        rank = np.argsort(family, kind="stable")
        place = np.empty(len(order), np.uint16 if len(order) <= 1 << 16 else np.int32)
        place[rank] = np.arange(len(order))
        # A block on a border goes to the family of its middle example.
        middles = np.minimum(np.arange(size // 2, len(order) + size // 2, size), len(order) - 1)
        families = np.unique(np.searchsorted(family[rank][middles], np.arange(family.max() + 1), side="right"))
        return cls(vocabulary, idf, unknown, np.array([ids[order[i]] for i in rank], dtype=np.int64), np.array([labels[order[i]] for i in rank], dtype=np.int64), rank, families[families > 0], size, starts, place[examples], weights, dense)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_reader": None, "_parts": None}

    def forget(self) -> None:
        """Free what was worked out for searching; it is worked out again where it is needed."""
        self._reader = self._parts = None

    def only_search(self) -> BlockMaxIndex:
        """Lay out what searching needs and let go of the postings, as a task may that scores alone."""
        if self._parts is None:
            self._dense_parts()
            self.examples, self.weights = self.examples[:0], self.weights[:0]
        return self

    def reader(self) -> Reader:
        if self._reader is None:
            self._reader = Reader(self.vocabulary)
        return self._reader

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the vocabulary and their weights in the unit TF-IDF vector of all terms; empty where none is known."""
        return unit_vector(*self.reader().read(text), self.idf, self.unknown)

    def vectors(self, texts: Sequence[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """``vector`` of each text."""
        return [v for x in self.reader().read_all(texts) for v in unit_vectors(*x, self.idf, self.unknown)]

    def _dense_parts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[Shelf]]:
        """Starts, examples and weights of the postings that no matrix has, each term's place in the matrix of each family, -1
        where it has none, and the matrices."""
        if self._parts is None:
            met, shelves = np.diff(self.starts), []
            term = np.repeat(np.arange(len(met), dtype=np.int32), met)
            laid = np.zeros(len(term), bool)
            slots = np.full((len(met), len(self.families)), -1, np.int16 if self.dense < 1 << 15 else np.int32)
            for f, (a, z) in enumerate(zip(np.append(0, self.families), self.families, strict=False)):
                posting = np.flatnonzero((self.examples >= a * self.size) & (self.examples < z * self.size)).astype(np.int32)
                common = np.bincount(term[posting], minlength=len(met))
                chosen = np.argsort(-common, kind="stable")[: self.dense]
                chosen = np.sort(chosen[common[chosen] > (z - a) * self.size / SHARED])
                slots[chosen, f] = np.arange(len(chosen))
                posting = posting[slots[term[posting], f] >= 0]
                laid[posting] = True
                example, at = self.examples[posting] - a * self.size, slots[term[posting], f]
                weights = np.zeros((z - a, len(chosen), self.size))
                weights[example // self.size, at, example % self.size] = self.weights[posting]
                shelves.append(Shelf(int(a), weights, np.ascontiguousarray(weights.max(axis=2, initial=0.0).T)))
            starts = np.append(0, np.cumsum(met - np.bincount(term[laid], minlength=len(met))))
            del term, posting, example, at
            self._parts = starts, self.examples[~laid], self.weights[~laid], slots, shelves
        return self._parts

    def nearest(self, vector: Vector, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k examples of the largest cosine above 0, ties to the smaller place; exact."""
        return self.nearest_of([vector], k, [skip])[0]

    def nearest_of(self, vectors: Sequence[Vector], k: int, skip: Sequence[int | None] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` for many vectors side by side.

        A block's bound is the sum of its largest weights over the terms with many postings, and the largest sum of its
        examples over all others, whose few postings are added up outright. The blocks of the largest bounds are opened
        first, then those whose bound still reaches the k-th cosine.
        """
        starts, examples, weights, slots, shelves = self._dense_parts()
        blocks, width = -(-len(self.ids) // self.size), -(-len(self.ids) // self.size) * self.size
        rest = np.zeros((len(vectors), width))
        pairs = [_arrays(v) for v in vectors]
        row = np.repeat(np.arange(len(pairs)), [len(t) for t, _ in pairs])
        term, weight = (np.concatenate([np.zeros(0, np.int64), *x]) for x in zip(*pairs, strict=True))
        begin = starts[term]
        sizes = starts[term + 1] - begin
        ends = np.searchsorted(row, np.arange(len(pairs) + 1)).tolist()
        for i, (a, z) in enumerate(zip(ends, ends[1:], strict=False)):
            posting = _ranges(begin[a:z], sizes[a:z])
            product = weights[posting]
            product *= np.repeat(weight[a:z], sizes[a:z])
            rest[i] = np.bincount(examples[posting], product, width)
        bounds = rest.reshape(len(vectors), blocks, self.size).max(axis=2)
        place, dense = slots[term].T, []
        for shelf, at in zip(shelves, place, strict=True):
            on = np.flatnonzero(at >= 0)
            dense.append(np.zeros((len(vectors), len(shelf.largest))))
            dense[-1][row[on], at[on]] = weight[on]
            bounds[:, shelf.first : shelf.first + len(shelf.weights)] += dense[-1] @ shelf.largest
        scores = np.zeros((len(vectors), width))

        def open_(mask: np.ndarray) -> None:
            for shelf, given in zip(shelves, dense, strict=True):
                for block, matrix in enumerate(shelf.weights, shelf.first):
                    who, at = np.flatnonzero(mask[:, block]), slice(block * self.size, (block + 1) * self.size)
                    if len(who):
                        scores[who, at] = given[who] @ matrix + rest[who, at]
            for i, place in enumerate(skip or []):
                if place is not None:
                    scores[i, place] = 0.0

        few = min(blocks, 3 * -(-k // self.size) + 3)
        first = np.zeros(bounds.shape, bool)
        best = np.argpartition(-bounds, few - 1, axis=1)[:, :few]
        np.put_along_axis(first, best, True, axis=1)
        first &= bounds > 0
        open_(first)
        least = np.zeros(len(vectors))
        if k < width:
            opened = np.take_along_axis(scores.reshape(len(vectors), blocks, self.size), best[:, :, None], axis=1).reshape(len(vectors), -1)
            least = np.partition(opened, opened.shape[1] - k, axis=1)[:, opened.shape[1] - k]
        open_((bounds >= least[:, None] - 1e-12) & (bounds > 0) & ~first)
        out = []
        for row, enough in zip(scores, least, strict=True):
            hit = np.flatnonzero((row > 0) & (row >= enough))
            if len(hit) > k:
                hit = hit[row[hit] >= np.partition(row[hit], len(hit) - k)[len(hit) - k]]
            near = hit[np.lexsort((self.rank[hit], -row[hit]))[:k]]
            out.append((near, row[near]))
        return out


def unit_vector(place: np.ndarray, counts: np.ndarray, idf: np.ndarray, unknown: float) -> tuple[np.ndarray, np.ndarray]:
    """Known terms and their weights; terms that no example has count in the norm, with the IDF ``unknown``."""
    return unit_vectors(place, counts, np.array([0, len(place)]), idf, unknown)[0]


def unit_vectors(place: np.ndarray, counts: np.ndarray, cuts: np.ndarray, idf: np.ndarray, unknown: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """``unit_vector`` of each text that begins at a cut; the last cut is the end."""
    known = place < len(idf)
    weight = np.full(len(place), unknown)
    weight[known] = idf[place[known]]
    raw = (1 + np.log(counts)) * weight
    cuts = cuts.tolist()
    # A text without terms divides by 1.
    raw /= np.repeat([math.sqrt(raw[a:z] @ raw[a:z]) or 1.0 for a, z in zip(cuts, cuts[1:], strict=False)], np.diff(cuts))
    place, raw, ends = place[known], raw[known], np.append(0, np.cumsum(known))[cuts].tolist()
    return [(place[a:z], raw[a:z]) for a, z in zip(ends, ends[1:], strict=False)]


@dataclass
class NearestExamples:
    """Votes of the nearest examples, made into probabilities; ``unknown`` is that of a text without a known term."""

    index: BlockMaxIndex
    k: int
    prior: float
    slope: float
    shift: float
    unknown: float

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Share of label 1 among the neighbours, weighted by squared cosine; the prior counts as one weak neighbour."""
        w = cosines**2
        return float((w @ self.index.labels[places] + 0.1 * self.prior) / (w.sum() + 0.1))

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        return self.score_all([text])[0]

    def score_all(self, texts: Sequence[str], together: int = 128) -> list[tuple[float, list[tuple[int, int, float]]]]:
        """Score and evidence of each text; equal texts are scored once."""
        distinct = list(dict.fromkeys(texts))
        found: dict[str, tuple[float, list[tuple[int, int, float]]]] = {}
        for a in range(0, len(distinct), together):
            some = distinct[a : a + together]
            vectors = self.index.vectors(some)
            for text, vector, (places, cosines) in zip(some, vectors, self.index.nearest_of(vectors, self.k), strict=True):
                if not len(vector[0]):
                    found[text] = self.unknown, []
                    continue
                p = 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * self.vote(places, cosines) + self.shift))))
                found[text] = p, [(int(self.index.ids[i]), int(self.index.labels[i]), float(c)) for i, c in zip(places[:3], cosines[:3], strict=True)]
        return [found[t] for t in texts]


def _calibrate(votes: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve over votes, by Newton's method with a little ridge."""
    x = np.stack([votes, np.ones_like(votes)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        slope = x.T @ (weight * (p - labels)) + 1e-2 * w
        w = w - np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2), slope)
    return float(w[0]), float(w[1])


def _document_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(label, t) for label, text in zip(batch.column("label").to_pylist(), batch.column("text"), strict=True) for t in terms(text.as_py() or "")]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.string())], ["label", "term"])


def train(docs: DataFrame, labels: DataFrame, max_examples: int = 4_000, k: int = 15, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> NearestExamples | None:
    """Index at most ``max_examples`` labelled documents, half of each label at most, those of the smallest id hash.

    All terms of the examples make up the vocabulary. A term's weight is its IDF, with document frequencies counted over
    all documents, times the correlation of presence and label among the examples (the root of chi-square over n, both
    plus 1). A term that no example has is taken as one that no other document has and no label prefers. What is broadcast
    grows with the examples' texts, never with the documents. None where one label has no document or no example has a term.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").distinct()
    picked = [known.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples // 2) for y in (0, 1)]
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    examples = written(texts.join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id"), "toxicity-examples")
    totals = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    if len(totals) < 2:
        return None
    pos, neg = float(totals[1]), float(totals[0])
    seen = examples.select("label", "text").mapInArrow(_document_terms, "label int, term string").groupBy("term").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
    n, with_term = pos + neg, F.col("a") + F.col("b")
    chi = n * F.pow(F.col("a") * neg - F.col("b") * pos, F.lit(2)) / (with_term * (n - with_term + 0.5) * pos * neg)
    met = seen.select("term", F.sqrt((chi + 1) / (n + 1)).alias("weight")).orderBy("term").toArrow()
    if not len(met):
        return None
    spark, vocabulary = docs.sparkSession, Terms(met.column("term").combine_chunks())
    places = spark.sparkContext.broadcast(vocabulary)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(places.value)
        count, rows = np.zeros(reader.size, np.int64), 0
        for batch in batches:
            rows += len(batch)
            for a in range(0, len(batch), TOGETHER):
                met = Counter(_texts(batch.column(0), a))
                times = iter(met.values())
                for found, _, cuts in reader.read_all(list(met)):
                    known = found < reader.size
                    np.add.at(count, found[known], np.repeat(list(islice(times, len(cuts) - 1)), np.diff(cuts))[known])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(-1, np.flatnonzero(count)), pa.int32()), pa.array(np.append(rows, count[count > 0]), pa.int64())], ["term", "n"])

    df = texts.select("text").mapInArrow(frequencies, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, total = df.column("term").to_numpy(), df.column("n").to_numpy()
    count = np.zeros(len(vocabulary), np.int64)
    count[at[at >= 0]] = total[at >= 0]
    rows = int(total[at < 0][0])
    idf = (np.log((1 + rows) / (1 + count)) + 1) * met.column("weight").to_numpy()
    del count, at, total
    unknown = (math.log((1 + rows) / 2) + 1) * math.sqrt(1 / (n + 1))
    given = spark.sparkContext.broadcast(idf)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(places.value)
        for batch in batches:
            found = [unit_vector(*reader.read(t.as_py() or ""), given.value, unknown) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([v[0].astype(np.int32) for v in found], pa.list_(pa.int32())), pa.array([v[1] for v in found], pa.list_(pa.float64()))], ["doc_id", "label", "terms", "weights"])

    made = written(examples.select("doc_id", "label", "text").mapInArrow(vectors, "doc_id long, label int, terms array<int>, weights array<double>"), "toxicity-vectors")
    if pos + neg > max_examples:  # ids that stand for several texts
        made = made.orderBy("doc_id", "label", "terms", "weights").limit(max_examples)
    for shared in (places, given):
        shared.destroy()
    del df, met
    rows = made.toArrow()
    ids, marks = rows.column("doc_id").to_pylist(), rows.column("label").to_pylist()
    # Views of the rows' own memory, chunk by chunk.
    pairs = list(zip(*([x.values.to_numpy() for chunk in rows.column(c).chunks for x in chunk] for c in ("terms", "weights")), strict=True))
    give_back()
    index = BlockMaxIndex.build(pairs, ids, marks, vocabulary, idf, unknown=unknown)
    del pairs, rows
    give_back()
    share = known.agg(F.avg("label")).first()[0]
    model = _fit(index, k, share)
    give_back()
    return model


def _fit(index: BlockMaxIndex, k: int, share: float) -> NearestExamples:
    """Calibrate on each example's vote without itself, with both labels weighed back to their share."""
    model = NearestExamples(index, k, share, 0.0, 0.0, share)
    weight = np.where(index.labels == 1, share / max(1, (index.labels == 1).sum()), (1 - share) / max(1, (index.labels == 0).sum())) * len(index.ids)
    term = np.repeat(np.arange(len(index.vocabulary), dtype=np.int32), np.diff(index.starts))
    order = np.argsort(index.examples, kind="stable").astype(np.int32)
    ends = np.searchsorted(index.examples[order], np.arange(len(index.ids) + 1))
    own = [order[a:z] for a, z in zip(ends, ends[1:], strict=False)]
    known = np.array([len(x) > 0 for x in own])
    votes = []
    for a in range(0, len(own), 128):
        some = own[a : a + 128]
        met = index.nearest_of([(term[x], index.weights[x]) for x in some], k, range(a, a + len(some)))
        votes += [model.vote(*m) for m in met]
    votes = np.array(votes)
    model.slope, model.shift = _calibrate(votes[known], index.labels[known], weight[known])
    none = weight[~known]
    model.unknown = float((none @ index.labels[~known] + share) / (none.sum() + 1))
    index.forget()
    return model


def _for_scores(shared: Broadcast) -> NearestExamples | None:
    """A task's own copy, made smaller; what the worker's earlier tasks have freed goes back to the system first."""
    give_back()
    if shared.value:
        shared.value.index.only_search()
        give_back()
    return shared.value


def score(docs: DataFrame, model: NearestExamples | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, evidence) of every whole text: the probability of label 1, and the three nearest examples.

    A null or empty text, or one without a known term, has the examples' probability of such a text and no evidence.
    Null and repeated ids are rows like any other; without a model every score is 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kind = _for_scores(shared), pa.list_(pa.struct([("example", pa.int64()), ("label", pa.int32()), ("cosine", pa.float64())]))
        for batch in batches:
            found = [x for a in range(0, len(batch), TOGETHER) for x in model.score_all(_texts(batch.column(1), a))] if model else [(0.0, [])] * len(batch)
            evidence = pa.array([[dict(zip(("example", "label", "cosine"), e, strict=True)) for e in x] for _, x in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p for p, _ in found], pa.float64()), evidence], ["doc_id", "score", "evidence"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, SCORED)


def keep(docs: DataFrame, model: NearestExamples | None, below: float, text_col: str = "text") -> DataFrame:
    """The rows of documents that score below ``below``, with all their columns; without a model, all rows."""
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _for_scores(shared)
        for batch in batches:
            texts = batch.column(text_col)
            yield batch.filter(pa.array([p < below for a in range(0, len(batch), TOGETHER) for p, _ in model.score_all(_texts(texts, a))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
