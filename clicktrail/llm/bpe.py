"""Byte-pair encoding with a lexicon in a minimal acyclic transducer.

Frequent words are counted over the corpus, encoded once and compiled into an automaton in which words share prefixes
and suffixes. Arcs carry numbers whose sum along a word's path is the word's place in the list of outputs, its ids.
The automaton is one block of integers, made for a memory map. Words it doesn't hold are merged by the vocabulary's
rules.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.sources.scratch import written

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
FEW = 64
"""Words of more bytes are merged one by one through a heap."""
NONE = 1 << 40
PORTION = 1 << 20
"""Code points of text that are encoded together."""


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Vocabulary:
    """Ids, merge rules and special tokens of a byte-level BPE file."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, encoding="utf-8") as f:
            parsed = json.load(f)
        model, letters = parsed["model"], _byte_letters()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = model["vocab"]
        self.first = [0] * 256
        for letter, b in letters.items():
            self.first[b] = ids[letter]
        self.merges = {(ids[a], ids[b]): (rank, ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        codes = np.array([ids[a] << 32 | ids[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(codes)
        self.codes, self.ranks = codes[order], order.astype(np.int64)
        self.joined = np.array([ids[a + b] for a, b in pairs], dtype=np.int64)
        self.special = {t["content"]: t["id"] for t in parsed["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in parsed["added_tokens"]):
            raise ValueError("special tokens must be plain strings")
        self.bytes_of = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            self.bytes_of[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.words = regex.compile(pattern)
        longest = sorted(self.special, key=len, reverse=True)
        self.specials = regex.compile("|".join(map(regex.escape, longest))) if longest else None

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Stretches of ordinary text, and special tokens with their ids."""
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            if m.start() > at:
                yield text[at : m.start()], None
            yield m[0], self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:], None

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, four bytes an id: the pair of lowest rank is merged, the leftmost first, until none is left."""
        out = [b""] * len(words)
        by_width: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            if len(word) > FEW:
                out[i] = np.array(self._merge_many([self.first[b] for b in word]), dtype="<u4").tobytes()
            else:
                by_width.setdefault(max(4, 1 << (len(word) - 1).bit_length()), []).append(i)
        for width, places in by_width.items():
            for at in range(0, len(places), 20_000):
                part = places[at : at + 20_000]
                for i, ids in zip(part, self._merge_together([words[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; ``NONE`` where there is no rule."""
        code = a << 32 | b
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where((self.codes[at] == code) & (b >= 0), self.ranks[at], NONE)

    def _merge_together(self, words: list[bytes], width: int) -> list[bytes]:
        """All words side by side, one merge of each in a step."""
        lengths = np.array([len(w) for w in words])
        ids = np.full((len(words), width + 1), -1, dtype=np.int64)
        ids[np.arange(width + 1) < lengths[:, None]] = np.array(self.first, dtype=np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        ranks = np.concatenate([self._rank(ids[:, :-1], ids[:, 1:]), np.full((len(words), 1), NONE)], axis=1)
        columns, live, done = np.arange(width + 1), np.arange(len(words)), ids.copy()
        while len(live):
            at = ranks.argmin(axis=1)
            rows = np.arange(len(live))
            best = ranks[rows, at]
            more = best < NONE
            if not more.all():
                done[live[~more]] = ids[~more]
                ids, ranks, live, at, best = ids[more], ranks[more], live[more], at[more], best[more]
                rows = np.arange(len(live))
                if not len(live):
                    break
            shifted = np.minimum(columns + (columns > at[:, None]), width)
            ids = np.take_along_axis(ids, shifted, axis=1)
            ids[:, -1] = -1
            ids[rows, at] = self.joined[best]
            ranks = np.take_along_axis(ranks, np.minimum(columns + (columns >= at[:, None]), width), axis=1)
            ranks[:, -1] = NONE
            ranks[rows, at] = self._rank(ids[rows, at], ids[rows, np.minimum(at + 1, width)])
            left = np.maximum(at - 1, 0)
            ranks[rows, left] = np.where(at > 0, self._rank(ids[rows, left], ids[rows, at]), ranks[rows, left])
        counts = (done >= 0).sum(axis=1)
        raw, ends = done[done >= 0].astype("<u4").tobytes(), 4 * np.cumsum(counts)
        return [raw[z - 4 * n : z] for z, n in zip(ends.tolist(), counts.tolist(), strict=True)]

    def _merge_many(self, ids: list[int]) -> list[int]:
        rules, n = self.merges, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(rules[p][0], i, p) for i, p in enumerate(zip(ids, ids[1:])) if p in rules]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (ids[i], ids[j]) != pair:
                continue
            ids[i], ids[j] = rules[pair][1], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (p := (ids[a], ids[b])) in rules:
                    heapq.heappush(heap, (rules[p][0], a, p))
        return [i for i in ids if i >= 0]


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


class Lexicon:
    """A minimal acyclic automaton over the bytes of words; a word's path adds up to its place in the outputs.

    One block of 32-bit integers: a head of five counts, for each state whether a word ends there, for each arc its
    state and byte in one key, its target and its number, for each word the start of its ids, then all ids. Keys rise.
    """

    def __init__(self, block: np.ndarray) -> None:
        states, arcs, words, ids, self.root = (int(x) for x in block[:5])
        cuts = np.cumsum([5, states, arcs, arcs, arcs, words + 1, ids])
        self.final, self.key, self.target, self.number, self.starts, self.ids = (block[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True))

    @classmethod
    def build(cls, entries: dict[bytes, bytes]) -> Lexicon:
        """Compile words, given with their ids, in byte order; states with the same future are one state."""
        known: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        size: list[int] = []

        def keep(node: tuple[list, list]) -> int:
            key = (node[0][0], tuple(node[1]))
            if key not in known:
                known[key] = len(states)
                states.append(key)
                size.append(key[0] + sum(size[t] for _, t in key[1]))
            return known[key]

        path: list[tuple[list, list]] = [([False], [])]
        letters: list[int] = []

        def close(depth: int) -> None:
            while len(letters) > depth:
                done = keep(path.pop())
                path[-1][1].append((letters.pop(), done))

        words = sorted(entries)
        for word in words:
            shared = len(os.path.commonprefix([bytes(letters), word]))
            close(shared)
            for b in word[shared:]:
                letters.append(b)
                path.append(([False], []))
            path[-1][0][0] = True
        close(0)
        root = keep(path[0])
        final, keys, target, number = [], [], [], []
        for state, (ends, arcs) in enumerate(states):
            final.append(int(ends))
            before = int(ends)
            for b, t in arcs:
                keys.append(state << 8 | b)
                target.append(t)
                number.append(before)
                before += size[t]
        starts = np.cumsum([0, *(len(entries[w]) // 4 for w in words)])
        ids = np.frombuffer(b"".join(entries[w] for w in words), dtype="<u4")
        head = [len(states), len(keys), len(words), len(ids), root]
        return cls(np.concatenate([np.array(x, dtype=np.int32) for x in (head, final, keys, target, number, starts, ids)]))

    def block(self) -> bytes:
        parts = (self.final, self.key, self.target, self.number, self.starts, self.ids)
        head = np.array([len(self.final), len(self.key), len(self.starts) - 1, len(self.ids), self.root], dtype=np.int32)
        return np.concatenate([head, *parts]).astype(np.int32).tobytes()

    @classmethod
    def map_file(cls, path: str) -> Lexicon:
        return cls(np.memmap(path, dtype=np.int32, mode="r"))

    @classmethod
    def map_block(cls, block: bytes) -> Lexicon:
        """Lay the block into a memory map of its own, which later forks of the worker share."""
        area = mmap.mmap(-1, len(block))
        area.write(block)
        return cls(np.frombuffer(area, dtype=np.int32))

    def find(self, words: list[bytes]) -> list[bytes | None]:
        """Ids of each word, or None; all words go along their paths side by side, a byte in each step."""
        out: list[bytes | None] = [None] * len(words)
        if not words or not len(self.key):
            return out
        lengths = np.array([len(w) for w in words])
        letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        starts = np.cumsum(lengths) - lengths
        live = np.arange(len(words))
        state, place = np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        for step in range(int(lengths.max())):
            ended = lengths[live] == step
            self._give(out, live[ended], state[ended], place[ended])
            live, state, place = live[~ended], state[~ended], place[~ended]
            wanted = state << 8 | letters[starts[live] + step]
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            found = self.key[at] == wanted
            live, at = live[found], at[found]
            state, place = self.target[at].astype(np.int64), place[found] + self.number[at]
        self._give(out, live, state, place)
        return out

    def _give(self, out: list[bytes | None], rows: np.ndarray, state: np.ndarray, place: np.ndarray) -> None:
        at_end = self.final[state] == 1
        for row, p in zip(rows[at_end].tolist(), place[at_end].tolist(), strict=True):
            out[row] = self.ids[self.starts[p] : self.starts[p + 1]].tobytes()


class Codec:
    """Encode and decode whole texts; words seen lately are kept, ``remember`` at most."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon, remember: int = 300_000) -> None:
        self.vocabulary, self.lexicon, self.remember = vocabulary, lexicon, remember
        self.seen: dict[str, bytes] = {}

    def _learn(self, words: set[str]) -> None:
        """Look words up in the lexicon; merge those it doesn't hold."""
        fresh = sorted(words)
        raw = [w.encode("utf-8") for w in fresh]
        found = self.lexicon.find(raw)
        missing = [i for i, ids in enumerate(found) if ids is None]
        for i, ids in zip(missing, self.vocabulary.merge([raw[i] for i in missing]), strict=True):
            found[i] = ids
        self.seen.update(zip(fresh, found, strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= PORTION):
                size += len(texts[end])
                end += 1
            out += self._encode([list(self.vocabulary.parts(t)) for t in texts[at:end]])
            at = end
        return out

    def _encode(self, texts: list[list[tuple[str, int | None]]]) -> list[bytes]:
        findall = self.vocabulary.words.findall
        if len(self.seen) > self.remember:
            self.seen = {}
        words = [[findall(part) if special is None else special for part, special in parts] for parts in texts]
        fresh = {w for parts in words for part in parts if isinstance(part, list) for w in part} - self.seen.keys()
        if fresh:
            self._learn(fresh)
        known = self.seen.__getitem__
        return [b"".join([b"".join(map(known, part)) if isinstance(part, list) else part.to_bytes(4, "little") for part in parts]) for parts in words]

    def decode(self, ids: bytes) -> str:
        table = self.vocabulary.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, dtype="<u4").tolist()]).decode("utf-8", errors="replace")


_codecs: dict[tuple, Codec] = {}


def _codec(path: str, pattern: str, name: str, block: bytes) -> Codec:
    """The worker's codec, made once for each lexicon."""
    key = (path, pattern, name)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocabulary(path, pattern), Lexicon.map_block(block))
    return _codecs[key]


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def frequent_words(docs: DataFrame, path: str, pattern: str, words: int, longest: int = 48, flush: int = 300_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most ``words`` of the most frequent words of all texts, with their counts.

    A histogram of the counts (exact below 65,536, then in classes of 1/4096) says which counts are taken: all words
    of a class or none, so no list of words is sorted or gathered beyond those. Longer words are left to merging.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, counts = vocabulary(path, pattern), Counter()

        def out() -> pa.RecordBatch:
            found = [(w, n) for w, n in counts.items() if len(w) <= longest]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(1):
                for part, special in rules.parts(text.as_py() or ""):
                    if special is None:
                        counts.update(rules.words.findall(part))
                if len(counts) > flush:
                    yield out()
        yield out()

    counted = _texts(docs, id_col, text_col).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    step = F.when(F.col("n") < 1 << 16, 1).otherwise(F.pow(F.lit(2.0), F.floor(F.log2("n")) - 12).cast("long"))
    counted = written(counted.withColumn("least", F.col("n") - F.col("n") % step), "bpe-words")
    taken, least = 0, None
    for r in counted.groupBy("least").count().orderBy(F.desc("least")).collect():
        taken += r["count"]
        if taken > words:
            break
        least = r["least"]
    return counted.filter(F.col("least") >= least).select("word", "n") if least is not None else counted.select("word", "n").limit(0)


def lexicon(words: Iterable[str], path: str, pattern: str) -> Lexicon:
    rules = vocabulary(path, pattern)
    raw = [w.encode("utf-8") for w in words]
    return Lexicon.build(dict(zip(raw, rules.merge(raw), strict=True)))


def encode_decode(docs: DataFrame, path: str, pattern: str, words: int = 50_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids.

    Returns a row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256. The lexicon holds the ``words`` most
    frequent words and is broadcast, a few MB at the default. A null or empty text has no ids; null and repeated ids
    are rows like any other; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    frequent = [r["word"] for r in frequent_words(docs, path, pattern, words, id_col=id_col, text_col=text_col).collect()]
    shipped = spark.sparkContext.broadcast(lexicon(frequent, path, pattern).block())
    name = hashlib.sha256(shipped.value).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern, name, shipped.value)
        for batch in batches:
            rows = []
            for ids in codec.encode([text or "" for text in batch.column(1).to_pylist()]):
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest()))
            n, coded, decoded = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _texts(docs, id_col, text_col).mapInArrow(run, ENCODED)
