"""Exact self-join of documents by Jaccard similarity of their shingles, as components.

Documents of the same shingles are one class. Two linked classes share one of the first shingles of each, in an order
common to all (frequent shingles last, else by hash), so classes meet in the tile of a shingle and a band of sizes.
Large tiles are cut into parts, and parts are compared in pairs. Inside a tile, sizes and then hashed bitmaps bound the overlap from above; what is left
is decided by intersecting sorted arrays. Links inside a component that is known already need no test: each class is
first compared in one tile of its own, and then only classes of different components are compared in the others. Tiles
give back stars that join the same classes, never all pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.sources.scratch import written

NARROW, WIDE = 256, 1 << 17
"""Bits of the bitmaps of the smallest and of the largest sets."""
PIECE = 1 << 17
SIDE_BY_SIDE = 1 << 17
"""Short texts are hashed together, in stretches of some so many bytes."""
AT_ONCE = 500
"""Of so many texts the sets are held at once."""
BROADCAST_ENTRIES = 500_000
"""A lookup side of at most so many entries (of some 50 bytes) is broadcast after they were counted; a larger one is shuffled."""
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_BASE, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
_STEP = np.array([pow(_BASE, 2 * j + 1, 1 << 64) for j in range(8)], dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(_MIX1)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(_MIX2)
        return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2^64."""
    inverse = pow(_BASE, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate([[np.uint64(1)], np.full(2 * PIECE, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, inverse))


def _pieces(raw: bytes) -> Iterator[bytes]:
    """Stretches of at most some ``PIECE`` bytes that end between words; a longer word is a stretch of its own."""
    at = 0
    while at < len(raw):
        end = min(at + PIECE, len(raw))
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end


def _words(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words between white space, with A-Z as a-z.

    Words of more than ``PIECE`` bytes, wherever they stand, are hashed by blake2b, all others by a polynomial.
    """
    begin, out, at = [], [], 0
    for piece in _pieces(raw):
        letters = np.frombuffer(piece, np.uint8)
        space = _SPACE[letters]
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        hashes = np.zeros(len(starts), np.uint64)
        long = ends - starts > PIECE
        for i in np.flatnonzero(long):
            word = _FOLD[letters[starts[i] : ends[i]]].astype(np.uint8)
            hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        # A piece ends with its first word that reaches PIECE bytes, so what stands before a long word fits the powers.
        reach = int(starts[long][0]) if long.any() else len(piece)
        power, inverse = _powers()
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((_FOLD[letters[:reach]] + np.uint64(1)) * power[:reach], dtype=np.uint64)])
            a, z = starts[~long], ends[~long]
            hashes[~long] = _mix((sums[z] - sums[a]) * inverse[a] + (z - a).astype(np.uint64) * np.uint64(_MIX2))
        begin.append(starts + at)
        out.append(hashes)
        at += len(piece)
    return (np.concatenate(begin), np.concatenate(out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word, as in ``_words``."""
    return _words(raw)[1]


def _runs(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, in the order of the text; of all words where there are fewer."""
    n = len(words)
    width = min(n, k)
    with np.errstate(over="ignore"):
        sums = np.full(n - width + 1, width if n < k else 0, np.uint64)
        for j in range(width):
            sums = _mix(sums + words[j : n - width + 1 + j] * _STEP[j % 8])
    return sums


def shingle_sets(texts: Iterable[str], k: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of k words in a row; of all words where there are fewer; empty without words."""

    def sets(raws: list[bytes]) -> Iterator[np.ndarray]:
        starts, words = _words(b" ".join(raws))
        ends = np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raws])).tolist()
        runs = _runs(words, k) if len(words) >= k else words
        for start, end in zip([0, *ends[:-1]], ends, strict=True):
            if end - start < k:
                yield _runs(words[start:end], k) if end > start else words[:0]
            else:
                found = np.sort(runs[start : end - k + 1])
                yield found[np.concatenate([[True], found[1:] != found[:-1]])]

    held, size = [], 0
    for text in texts:
        raw = text.encode("utf-8")
        if held and size + len(raw) > SIDE_BY_SIDE:
            yield from sets(held)
            held, size = [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield from sets(held)


def shingle_set(text: str, k: int = 5) -> np.ndarray:
    """The set of one text, as in ``shingle_sets``."""
    return next(shingle_sets([text], k))


def _bitmap(shingles: np.ndarray) -> bytes:
    """A bit for each shingle, in as many bits as shingles, up to a power of two."""
    width = min(WIDE, max(NARROW, 1 << (len(shingles) - 1).bit_length()))
    bits = np.zeros(width, bool)
    bits[(shingles & np.uint64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def _digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def _least(n, percent: int):
    """The overlap with any linked set that a set of n needs."""
    return -(-n * percent // 100)


def _first(shingles: np.ndarray, frequent: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in the common order, as many as make sure that two linked sets share one."""
    at = np.searchsorted(frequent, shingles)
    common = frequent[np.minimum(at, len(frequent) - 1)] == shingles if len(frequent) else np.zeros(len(shingles), bool)
    ordered = np.concatenate([shingles[~common], shingles[common]])
    return ordered[: len(shingles) - _least(len(shingles), percent) + 1].view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, ``AT_ONCE`` at a time."""
    for batch in batches:
        yield from (batch.slice(at, AT_ONCE) for at in range(0, len(batch), AT_ONCE))


def frequent_shingles(texts: DataFrame, k: int, percent: int, at_most: int = 1_000_000) -> np.ndarray:
    """Shingles that many sets begin with, sorted; only the common order depends on them, no result does.

    Each task counts its share of the rows and reports what it met twice; the sums above a limit that leaves no more
    than ``at_most`` (8 MB) are taken.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def report(parts: list[np.ndarray]) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            rows = pa.array([sum(map(len, parts))], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([values[counts > 1]], pa.list_(pa.int64())), pa.array([counts[counts > 1]], pa.list_(pa.int64())), rows], ["shingle", "n", "rows"])

        parts, held = [], 0
        for batch in batches:
            for shingles in shingle_sets((t.as_py() for t in batch.column(0)), k):
                parts.append(_first(shingles, np.zeros(0, np.uint64), percent))
                held += len(parts[-1])
                if held > 4_000_000:
                    yield report(parts)
                    parts, held = [], 0
        yield report(parts)

    met = written(texts.select("text").mapInArrow(count, "shingle array<long>, n array<long>, rows long"), "jaccard-frequent")
    rows = met.agg(F.sum("rows")).first()[0] or 0
    summed = met.select(F.inline(F.arrays_zip("shingle", "n"))).groupBy("shingle").agg(F.sum("n").alias("n"))
    found = summed.filter(F.col("n") > max(100, rows // at_most)).select("shingle").toArrow()
    return np.sort(found.column(0).to_numpy().view(np.uint64))


def signatures(texts: DataFrame, frequent: np.ndarray, k: int, percent: int) -> DataFrame:
    """(doc_id, n, digest, bitmap, first) of every text; the digest is that of the shingles, null for an empty set."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _stretches(batches):
            rows = []
            for s in shingle_sets((t.as_py() for t in batch.column(1)), k):
                rows.append((len(s), _digest(s), _bitmap(s), _first(s, shared.value, percent)) if len(s) else (0, None, None, None))
            n, digest, bitmap, first = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bitmap, pa.binary()), pa.array(first, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "bitmap", "first"])

    return texts.mapInArrow(sign, "doc_id long, n long, digest binary, bitmap binary, first array<long>")


def _whole_groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of a sorted stream, with the rows at which groups begin and the end."""
    held: list[pa.Table] = []

    def changes(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        for name in key:
            c = table.column(name).to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not len(batch):
            continue
        table = pa.concat_tables([*held, pa.Table.from_batches([batch])]).combine_chunks()
        cuts = changes(table)
        if len(cuts):
            yield table.slice(0, cuts[-1]), np.array([0, *cuts])
            held = [table.slice(cuts[-1])]
        else:
            held = [table]
    if held:
        table = pa.concat_tables(held)
        yield table, np.array([0, len(table)])


def _folded(bitmap: bytes, width: int) -> np.ndarray:
    """A bitmap in fewer bits, which is the one that the shingles would have had there."""
    return np.bitwise_or.reduce(np.frombuffer(bitmap, np.uint64).reshape(-1, width // 64), axis=0)


def _possible(n: np.ndarray, bitmaps: list[bytes], a: np.ndarray, b: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b), by place, that sizes and bitmaps allow to be linked, and the bits in which they differ.

    A bit that one set has and the other hasn't stands for a shingle outside the overlap, at least. Bitmaps of two
    widths are compared in the narrower one.
    """
    fits = np.flatnonzero(100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
    widths = 8 * np.array([len(x) for x in bitmaps])
    narrow = np.minimum(widths[a[fits]], widths[b[fits]])
    places, differing = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for width in np.unique(narrow).tolist():
        at = fits[narrow == width]
        bits = np.zeros((len(bitmaps), width // 64), np.uint64)
        for r in np.flatnonzero(widths >= width).tolist():
            bits[r] = _folded(bitmaps[r], width) if widths[r] > width else np.frombuffer(bitmaps[r], np.uint64)
        held = np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        step = max(1, (1 << 24) // width)
        for start in range(0, len(at), step):
            part = at[start : start + step]
            p, q = a[part], b[part]
            common = np.bitwise_count(bits[p] & bits[q]).sum(axis=1, dtype=np.int64)
            only_a, only_b = held[p] - common, held[q] - common
            x, y = n[p], n[q]
            both = np.minimum(x - only_a, y - only_b)
            maybe = 100 * both >= percent * (x + y - both)
            places.append(part[maybe])
            differing.append((only_a + only_b)[maybe])
    return np.concatenate(places), np.concatenate(differing)


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _pairs(size: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(size, 1)


def _stars_of(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Links that join the same names: in each component, all others to the smallest one."""
    lead: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := lead.setdefault(x, x)) != x:
            lead[x] = x = lead[up]
        return x

    for a, b in links:
        x, y = top(a), top(b)
        lead[max(x, y)] = min(x, y)
    return [(r, x) for x in lead if (r := top(x)) != x]


def _forest(percent: int, apart: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For the tiles (tile, i, j) stars (a, b) that join those classes that links join; with ``apart``, known components are one
    to begin with, and stars join their names."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _whole_groups(batches, ["tile", "i", "j"]):
            names = table.column("class").to_pylist()
            n, bitmaps = table.column("n").to_numpy(), table.column("bitmap").to_pylist()
            known = table.column("component").to_pylist() if apart else names
            sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
            out: list[tuple[int, int]] = []
            for start, end in zip(cuts[:-1].tolist(), [*cuts[1:-1].tolist(), len(table)], strict=True):
                lead = {known[r]: known[r] for r in range(start, end)}

                def top(x: int, lead: dict = lead) -> int:
                    while lead[x] != x:
                        lead[x] = x = lead[lead[x]]
                    return x

                a, b = _pairs(end - start)
                maybe, differing = _possible(n[start:end], bitmaps[start:end], a, b, percent)
                a, b = a + start, b + start
                for p in maybe[np.argsort(differing, kind="stable")].tolist():
                    x, y = top(known[a[p]]), top(known[b[p]])
                    if x != y and _linked(sets[a[p]], sets[b[p]], percent):
                        lead[y] = x
                        out.append((known[a[p]], known[b[p]]))
            out = _stars_of(out)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    return join


def _met_before(lists: np.ndarray, a: np.ndarray, b: np.ndarray, tile: int) -> np.ndarray:
    """Whether the pairs surely meet in a tile of a smaller number, by the first tiles of each class (padded with the last one)."""
    out = np.zeros(len(a), bool)
    for start in range(0, len(a), 50_000):
        x, y = lists[a[start : start + 50_000]], lists[b[start : start + 50_000]]
        same = (x[:, :, None] == y[:, None, :]).any(axis=2)
        out[start : start + 50_000] = (same & (x < tile)).any(axis=1)
    return out


def _undecided(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of tiles (tile, i, j) that sizes and bitmaps allow a link to a class of another component."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in _whole_groups(batches, ["tile", "i", "j"]):
            n, bitmaps = table.column("n").to_numpy(), table.column("bitmap").to_pylist()
            component = table.column("component").to_numpy()
            keep, tiles = np.zeros(len(table), bool), table.column("tile").to_numpy()
            lists = pc.list_flatten(table.column("tiles")).to_numpy().reshape(len(table), -1) if "tiles" in table.column_names else None
            for start, end in zip(cuts[:-1].tolist(), [*cuts[1:-1].tolist(), len(table)], strict=True):
                a, b = _pairs(end - start)
                other = component[start:end][a] != component[start:end][b]
                a, b = a[other], b[other]
                maybe, _ = _possible(n[start:end], bitmaps[start:end], a, b, percent)
                a, b = a + start, b + start
                if lists is not None:
                    maybe = maybe[~_met_before(lists, a[maybe], b[maybe], tiles[start])]
                keep[a[maybe]] = keep[b[maybe]] = True
            kept = table.select(["tile", "i", "j", "class"]).filter(pa.array(keep)).combine_chunks()
            yield from kept.to_batches() or [pa.RecordBatch.from_pylist([], schema=kept.schema)]

    return sift


def _stars(links: DataFrame) -> bool:
    """Whether every node has either one link to a smaller node or only links to larger ones."""
    ends = links.select(F.inline(F.array(*(F.struct(F.col(c).alias("node"), F.lit(int(c == "u")).alias("down"), F.lit(int(c == "v")).alias("up")) for c in ("u", "v")))))
    most = ends.groupBy("node").agg((F.sum("down") + F.max("up")).alias("n")).agg(F.max("n")).first()[0]
    return (most or 0) <= 1


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the edges; a component's name is its smallest node.

    Large-star and small-star steps in turn: every node's larger neighbours, then all of them, are tied to its smallest
    one, until only stars are left. Each step is written; no list of links leaves the executors.
    """
    links = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct(), "links")
    while not _stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = written(large, "links")
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(smallest, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(moved.unionByName(smallest.select("u", F.col("m").alias("v"))).distinct(), "links")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def join(docs: DataFrame, percent: int = 75, k: int = 5, band: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Link documents whose shingle sets have a Jaccard similarity of at least ``percent`` / 100.

    Returns a row per input row: doc_id, n_shingles and component_id, the smallest id that links reach. A null text
    counts as empty; texts without words have no shingles and no links. Rows of one id are documents of their own; a
    component whose ids are all null has a null name. An empty table gives an empty one.
    """
    texts = _texts(docs, id_col, text_col)
    signed = written(signatures(texts, frequent_shingles(texts, k, percent), k, percent), "jaccard-signed")
    nonempty = signed.filter("digest is not null")
    classes = nonempty.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.any_value(F.struct("n", "bitmap")).alias("one"))
    # Numbers stand for digests from here on; they are fixed once the table is written.
    classes = written(classes.select(F.monotonically_increasing_id().alias("class"), "digest", "doc_id", "one.*"), "jaccard-classes")
    by_first = Window.partitionBy("tile")
    code = F.xxhash64("class")
    firsts = nonempty.groupBy("digest").agg(F.any_value("first").alias("first")).join(classes.select("digest", "class", "n"), "digest").select("class", "n", F.explode("first").alias("tile"))
    met = firsts.withColumns({"size": F.count("*").over(by_first), "x": F.bit_xor(code).over(by_first), "y": F.bit_xor(F.xxhash64(code, F.lit(1))).over(by_first)})
    met = written(met.filter("size > 1"), "jaccard-met")
    chosen = met.groupBy("size", "x", "y").agg(F.min("tile").alias("tile")).select("tile")
    # Sizes of linked sets differ by less than a band, so each class stands in its own band and in the next.
    size_band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent * 1.0001)) if percent < 100 else F.col("n")
    shared = met.join(chosen, "tile", "left_semi").select("tile", "class", "n")
    bands = (F.struct(F.xxhash64("tile", size_band + i).alias("tile"), F.lit(i == 0).alias("own")) for i in (0, 1))
    shared = written(shared.select("class", F.inline(F.array(*bands))), "jaccard-banded")
    # Classes that only visit a band have met in their own.
    sizes = shared.groupBy("tile").agg(F.count("*").alias("size"), F.max("own").alias("own")).filter("size > 1 and own").select("tile", "size")
    tiles = written(shared.join(sizes, "tile").select("tile", "size", "class"), "jaccard-tiles")

    def with_sets(rows: DataFrame) -> DataFrame:
        """Rows of (class, ...) with the class's n, bitmap and shingles."""
        wanted = rows.groupBy("class").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "class"))).alias("rows")).join(classes.select("class", "digest", "doc_id"), "class")
        wanted = written(wanted.select("class", "digest", F.col("doc_id").alias("of"), "rows"), "jaccard-wanted")
        entries = wanted.agg(F.sum(F.size("rows") + 1)).first()[0] or 0
        side = F.broadcast(wanted) if entries <= BROADCAST_ENTRIES else wanted
        found = texts.join(side, F.col("doc_id").eqNullSafe(F.col("of"))).select("text", "class", "digest", "rows")

        def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _stretches(batches):
                made = list(shingle_sets((t.as_py() for t in batch.column("text")), k))
                same = [i for i, (s, w) in enumerate(zip(made, batch.column("digest").to_pylist(), strict=True)) if _digest(s) == w]
                kept = batch.take(pa.array(same, pa.int64()))
                made = [made[i] for i in same]
                yield pa.RecordBatch.from_arrays([kept.column("class"), kept.column("rows"), pa.array([len(s) for s in made], pa.int64()), pa.array([_bitmap(s) for s in made], pa.binary()), pa.array([s.tobytes() for s in made], pa.binary())], ["class", "rows", "n", "bitmap", "shingles"])

        kind = found.schema["rows"].dataType.simpleString()
        full = found.mapInArrow(sets, f"class long, rows {kind}, n long, bitmap binary, shingles binary")
        return full.select("class", "n", "bitmap", "shingles", F.inline("rows"))

    def in_tiles(rows: DataFrame, work, schema: str) -> DataFrame:
        return rows.repartition("tile", "i", "j").sortWithinPartitions("tile", "i", "j").mapInArrow(work, schema)

    def parted(size) -> Column:
        """Parts of a tile, each of some ``band`` classes, so that no task holds a whole hot tile."""
        return F.ceil((F.col(size) if isinstance(size, str) else size) / band).cast("int")

    own = tiles.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("size"), "tile"))).filter("r = 1")
    # A class meets its part of the tile, and some eight of all, which go to every part, tie the parts together.
    guide = F.pmod(F.xxhash64("class", F.lit(2)), F.ceil(F.col("size") / 8)) == 0
    parts = parted("size")
    at = F.when(guide, F.sequence(F.lit(0), parts - 1)).otherwise(F.array(F.pmod(F.xxhash64("class"), parts).cast("int")))
    own = own.select("class", "tile", F.explode(at).alias("i"), F.lit(0).alias("j"))
    own = own.join(classes.select("class", "n", "bitmap"), "class").withColumn("component", F.col("class"))
    likely = written(in_tiles(own, _undecided(percent), "tile long, i int, j int, class long"), "jaccard-likely")
    first_links = written(in_tiles(with_sets(likely), _forest(percent, False), "a long, b long"), "jaccard-links")
    known = written(components(first_links), "jaccard-components")

    named = tiles.join(known.withColumnRenamed("node", "class"), "class", "left")
    named = written(named.select("tile", "class", F.coalesce("component", "class").alias("component")), "jaccard-named")
    shares = named.groupBy("tile", "component").agg(F.count("*").alias("m"))
    largest = shares.groupBy("tile").agg(F.max_by("component", F.struct("m", "component")).alias("largest"), F.count("*").alias("parts"), F.sum("m").alias("size"), F.max("m").alias("most")).filter("parts > 1")
    open_tiles = named.join(largest, "tile")
    minor = F.col("component") != F.col("largest")
    all_parts, minor_parts = parted("size"), parted(F.col("size") - F.col("most"))
    banded = open_tiles.select("tile", "class", "component", minor.alias("minor"), F.pmod(F.xxhash64("class"), all_parts).cast("int").alias("part"), F.pmod(F.xxhash64("class", F.lit(3)), minor_parts).cast("int").alias("minor_part"), all_parts.alias("all_parts"), minor_parts.alias("minor_parts"))
    as_any = F.transform(F.sequence(F.lit(0), F.col("minor_parts") - 1), lambda i: F.struct(i.alias("i"), F.col("part").alias("j")))
    as_minor = F.when(F.col("minor"), F.transform(F.sequence(F.lit(0), F.col("all_parts") - 1), lambda j: F.struct(F.col("minor_part").alias("i"), j.alias("j")))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    spread = banded.select("tile", "class", "component", F.explode(F.array_distinct(F.concat(as_any, as_minor))).alias("at")).select("tile", "class", "component", "at.i", "at.j")
    # A pair is looked at in the first tile that both classes list, where they list a common one.
    listed = open_tiles.groupBy("class").agg(F.slice(F.array_sort(F.collect_set("tile")), 1, 8).alias("tiles"))
    listed = listed.select("class", F.concat("tiles", F.array_repeat(F.element_at("tiles", -1), 8 - F.size("tiles"))).alias("tiles"))
    spread = spread.join(classes.join(listed, "class").select("class", "n", "bitmap", "tiles"), "class")
    undecided = written(in_tiles(spread, _undecided(percent), "tile long, i int, j int, class long"), "jaccard-undecided")
    second = with_sets(undecided.select("class", "tile", "i", "j")).join(known.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    more = written(in_tiles(second, _forest(percent, True), "a long, b long"), "jaccard-links")

    # Only the names of known components are left to be tied.
    whole = components(more).select(F.col("node").alias("component"), F.col("component").alias("whole"))
    grouped = classes.select("class", "digest", "doc_id").join(known.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    grouped = grouped.join(whole, "component", "left").withColumn("component", F.coalesce("whole", "component"))
    least = grouped.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_class = grouped.join(least, "component").select("digest", "component_id")
    linked = nonempty.select("doc_id", F.col("n").alias("n_shingles"), "digest").join(of_class, "digest").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(signed.filter("digest is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def keep_one(docs: DataFrame, percent: int = 75, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with all their columns, of each component only the one with the smallest id.

    Rows of one id and one text count as one; rows of one id and other texts stay together, and so do rows without id.
    """
    linked = written(join(docs, percent, k, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias(id_col), "component_id"), "jaccard-linked")
    gone = linked.filter(F.col(id_col) != F.col("component_id")).select(id_col).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_ENTRIES else gone
    kept = docs.join(gone, id_col, "left_anti").select(docs.columns)
    repeated = linked.groupBy(id_col).count().filter(F.col("count") > 1).select(id_col)
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, id_col, "left_anti").unionByName(kept.join(repeated, id_col, "left_semi").dropDuplicates([id_col, text_col])).select(docs.columns)
