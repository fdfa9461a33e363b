"""Packing of tokenised documents into sequences of fixed length by linear grouping.

Lengths are integers up to the capacity, so the histogram of lengths is bounded and says all that the plan needs.
Large lengths fall into groups of equal cardinality and are rounded up to their group's largest; configurations of
these few sizes are chosen to fill a sequence; actual lengths take the places of the rounded ones; small lengths go
where they fit best. Spark tokenises, counts, numbers the pieces of each length and places them by the plan.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clicktrail.llm.sharding import _numbered
from clicktrail.llm.tokens import token_ids
from clicktrail.sources.scratch import written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass
class Bins:
    """``count`` sequences that hold pieces of the same lengths, in this order."""

    lengths: list[int]
    count: int
    used: int = field(init=False)

    def __post_init__(self) -> None:
        self.used = sum(self.lengths)


def _groups(lengths: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """Runs of (length, count) in falling order, cut into groups of equal cardinality."""
    each = -(-sum(n for _, n in lengths) // groups)
    out: list[list[tuple[int, int]]] = [[]]
    free = each
    for length, n in lengths:
        while n:
            if not free:
                out.append([])
                free = each
            take = min(n, free)
            out[-1].append((length, take))
            n, free = n - take, free - take
    return [g for g in out if g]


def _fill(room: int, sizes: list[int], left: list[int]) -> list[int]:
    """Counts per size whose total is as near to ``room`` from below as can be; larger sizes are preferred.

    ``reach[i]`` has bit t set if some of the first i sizes add up to t.
    """
    reach, mask = [1], (1 << (room + 1)) - 1
    for size, n in zip(sizes, left, strict=True):
        now = reach[-1]
        for _ in range(min(n, room // size)):
            more = now | (now << size) & mask
            if more == now:
                break
            now = more
        reach.append(now)
    total = reach[-1].bit_length() - 1
    out = [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        while not reach[i] >> total & 1:
            total -= sizes[i]
            out[i] += 1
    return out


def _configurations(sizes: list[int], left: list[int], capacity: int) -> Iterator[tuple[list[int], int]]:
    """(sizes' indexes, times): the largest size left goes first, the fullest choice of others beside it, as often as they last."""
    left = list(left)
    live = list(range(len(sizes)))
    while live := [i for i in live if left[i]]:
        first = live[0]
        left[first] -= 1
        chosen = _fill(capacity - sizes[first], [sizes[i] for i in live], [left[i] for i in live])
        left[first] += 1
        need = {i: n for i, n in zip(live, chosen, strict=True) if n}
        need[first] = need.get(first, 0) + 1
        times = min(left[i] // n for i, n in need.items())
        for i, n in need.items():
            left[i] -= n * times
        yield [i for i in live for _ in range(need.get(i, 0))], times


def _substitute(groups: list[list[tuple[int, int]]], configurations: Iterator[tuple[list[int], int]]) -> Iterator[Bins]:
    """Put actual lengths into the places of each configuration."""
    streams = [[list(run) for run in reversed(g)] for g in groups]

    def cut(g: int, n: int) -> list[list[int]]:
        out = []
        while n:
            run = streams[g][-1]
            take = min(n, run[1])
            out.append([run[0], take])
            run[1] -= take
            n -= take
            if not run[1]:
                streams[g].pop()
        return out[::-1]

    for places, times in configurations:
        runs = [cut(g, times) for g in places]
        while runs[0]:
            n = min(r[-1][1] for r in runs)
            yield Bins([r[-1][0] for r in runs], n)
            for r in runs:
                r[-1][1] -= n
                if not r[-1][1]:
                    r.pop()


def plan(histogram: dict[int, int], capacity: int, groups: int = 256, small: float = 1 / 8) -> list[Bins]:
    """Sequences for a histogram of lengths between 1 and ``capacity``."""
    limit = int(capacity * small)
    large = sorted(((x, n) for x, n in histogram.items() if n and x > limit), reverse=True)
    parts = _groups(large, groups) if large else []
    bins = list(_substitute(parts, _configurations([g[0][0] for g in parts], [sum(n for _, n in g) for g in parts], capacity)))
    by_room: dict[int, list[Bins]] = {}
    for b in bins:
        by_room.setdefault(capacity - b.used, []).append(b)
    rooms = sorted(by_room)

    def put(b: Bins) -> None:
        room = capacity - b.used
        if room not in by_room:
            by_room[room] = []
            bisect.insort(rooms, room)
        by_room[room].append(b)

    for length, n in sorted(((x, n) for x, n in histogram.items() if n and x <= limit), reverse=True):
        while n:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                put(Bins([], -(-n // (capacity // length))))
                continue
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            each = room // length
            full = min(b.count, n // each)
            rest = n - full * each if full < b.count else 0
            if full:
                put(Bins([*b.lengths, *[length] * each], full))
            if rest:
                put(Bins([*b.lengths, *[length] * rest], 1))
            if b.count > full + bool(rest):
                put(Bins(b.lengths, b.count - full - bool(rest)))
            n -= full * each + rest
    return [b for r in rooms for b in by_room[r] if b.lengths]


class Places:
    """Where the k-th piece of a length goes: for each length, runs of ranks that lie in the same bins."""

    def __init__(self, bins: list[Bins]) -> None:
        runs: dict[int, list[tuple[int, int, int]]] = {}
        filled: dict[int, int] = {}
        base = 0
        for b in bins:
            at = 0
            offsets: dict[int, list[int]] = {}
            for length in b.lengths:
                offsets.setdefault(length, []).append(at)
                at += length
            for length, found in offsets.items():
                for offset in found:
                    runs.setdefault(length, []).append((filled.get(length, 0), base, offset))
                    filled[length] = filled.get(length, 0) + b.count
            base += b.count
        self.runs = {length: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for length, r in runs.items()}

    def of(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of each piece."""
        sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        order = np.argsort(lengths, kind="stable")
        cuts = np.flatnonzero(np.diff(lengths[order], prepend=-1))
        for a, z in zip(cuts, [*cuts[1:], len(order)], strict=True):
            rows = order[a:z]
            starts, base, at = self.runs[int(lengths[rows[0]])]
            i = np.searchsorted(starts, ranks[rows], side="right") - 1
            sequence[rows], offset[rows] = base[i] + ranks[rows] - starts[i], at[i]
        return sequence, offset


def pieces(docs: DataFrame, path: str, ranks_path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise every whole text, add ``end_id``, and cut what is longer than ``capacity``; the first piece is the shorter one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(token_ids(text.as_py() or "", path, ranks_path, pattern), np.array([end_id], "<u4")).astype("<u4")
                at, piece = 0, 0
                while at < len(ids):
                    end = at + (capacity if (len(ids) - at) % capacity == 0 else (len(ids) - at) % capacity)
                    out.append((doc_id, piece, at, end - at, zlib.crc32(ids[at:end].tobytes())))
                    at, piece = end, piece + 1
            columns = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, path: str, ranks_path: str, pattern: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", buckets: int = 256) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` tokens.

    Returns a row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or empty text is the
    one id ``end_id``. Null and repeated ids are documents of their own; which of two pieces of one length comes first
    follows a hash, then id and piece. An empty table gives an empty one.
    """
    cut = written(pieces(docs, path, ranks_path, pattern, capacity, end_id, id_col, text_col), "pack-pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = Places(plan(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.of(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    ranked = _numbered(cut, "length", ["doc_id", "piece", "ids_crc32"], buckets, "rank")
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("rank").cast("long").alias("rank"))
    return ranked.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
