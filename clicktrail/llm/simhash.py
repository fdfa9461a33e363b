"""SimHash fingerprints, and a search for all fingerprints within a Hamming radius.

DataFrame functions only. Each shingle of five words votes with its hash, once for each time it stands in the text; a
bit is set where more than half of the votes set it. For the search the bits are cut into blocks: two fingerprints that
differ in at most ``radius`` bits agree in all but ``radius`` of the blocks, so one table for each choice of the other
blocks, keyed by their bits, holds every pair.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.sources.scratch import written

BITS = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _bit(i: int) -> Column:
    return F.lit((1 << i) - (1 << BITS) if i == BITS - 1 else 1 << i).cast("long")


def word_hashes(text: Column) -> Column:
    """Hashes of the words between white space, A-Z in lower case."""
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: Column, k: int = 5) -> Column:
    """Hashes of k words in a row; all words where there are fewer, nothing where there is none. ``words`` must be a column's name."""
    whole = F.array(F.xxhash64(words))
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - k), lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))
    return F.when(F.size(words) >= k, runs).when(F.size(words) > 0, whole).otherwise(F.array().cast("array<long>"))


def vote(hashes: DataFrame, key: list[str], hash_col: str = "h") -> DataFrame:
    """(key, fingerprint): the majority of each bit over all rows of a key; ties leave it unset. Rows are summed before any shuffle."""
    one = F.lit(1).cast("long")
    counted = hashes.groupBy(*key).agg(F.count("*").alias("n"), *(F.sum(F.shiftright(hash_col, i).bitwiseAND(one)).alias(f"b{i}") for i in range(BITS)))
    bits = (F.when(2 * F.col(f"b{i}") > F.col("n"), _bit(i)).otherwise(F.lit(0).cast("long")) for i in range(BITS))
    return counted.select(*key, reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / BITS


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), BITS // 4, "0"))


def _in_order(docs: DataFrame, parts: int) -> DataFrame:
    """Each row with the text of the row after it by doc_id (then text); after the last comes the first.

    Ids are cut into ranges at ids that occur, so that a range's successor starts with a known id: rows with that id
    go to the range before as well, marked ``ghost``, and no window spans more than one range. Only the range borders
    come to the driver.
    """
    shares = [i / parts for i in range(1, parts)] or [0.5]
    seen = docs.agg(F.min("doc_id").alias("least"), F.percentile_approx("doc_id", shares, max(10_000, 10 * parts)).alias("cuts"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    cuts = sorted({seen["least"], *seen["cuts"]}) if seen["least"] is not None else []
    bounds = F.split(F.lit(" ".join(map(str, cuts))), " ").cast("array<long>") if cuts else F.array().cast("array<long>")
    first, last = (0 if seen["nulls"] else 1), len(cuts)
    part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))))
    starts = F.coalesce(F.array_contains(bounds, F.col("doc_id")), F.lit(True))

    def place(part: Column, ghost: bool, wrapped: bool) -> Column:
        return F.struct(part.cast("int").alias("part"), F.lit(ghost).alias("ghost"), F.lit(wrapped).alias("wrapped"))

    own = place(F.col("part"), False, False)
    before = F.when(F.col("part") == first, place(F.lit(last), True, True)).otherwise(place(F.col("part") - 1, True, False))
    placed = docs.withColumn("part", part).select("doc_id", "text", F.explode(F.when(starts, F.array(own, before)).otherwise(F.array(own))).alias("at")).select("doc_id", "text", "at.*")
    order = Window.partitionBy("part").orderBy("wrapped", F.col("doc_id").asc_nulls_first(), "text")
    return placed.select("part", F.row_number().over(order).alias("place"), "ghost", "doc_id", "text", F.lead("text").over(order).alias("next"))


def fingerprints(docs: DataFrame, k: int = 5, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every whole text and its edited text, whose last half is the beginning of the next document.

    Returns a row per input row: doc_id, n_chars, edited_sha256, fingerprint and edited_fingerprint (bits of a long),
    near_edited and near_next. A null text counts as empty; a text without words has the fingerprint 0. Documents go
    by id, nulls first, equal ids by text; a table of one document is its own successor; an empty table gives an empty
    one. Texts are shuffled once, by ranges of ids.
    """
    spark = docs.sparkSession
    parts = parts or 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    ordered = _in_order(texts, parts)
    about = ordered.select("part", "place", "ghost", "doc_id", n.cast("long").alias("n_chars"), F.when(~F.col("ghost"), F.sha2(edited.cast("binary"), 256)).alias("edited_sha256"))
    both = F.when(F.col("ghost"), F.array("text")).otherwise(F.array("text", edited))
    words = ordered.select("part", "place", F.posexplode(both).alias("which", "text")).select("part", "place", "which", word_hashes(F.col("text")).alias("words"))
    hashes = words.select("part", "place", "which", F.explode(shingle_hashes(F.col("words"), k)).alias("h"))
    voted = vote(hashes, ["part", "place", "which"])
    made = voted.groupBy("part", "place").agg(*(F.max(F.when(F.col("which") == i, F.col("fingerprint"))).alias(name) for i, name in enumerate(("fingerprint", "edited_fingerprint"))))
    rows = about.join(made, ["part", "place"], "left").fillna(0, ["fingerprint", "edited_fingerprint"])
    following = F.lead("fingerprint").over(Window.partitionBy("part").orderBy("place"))
    rows = rows.withColumn("following", following).filter(~F.col("ghost"))
    near = {"near_edited": likeness(F.col("fingerprint"), F.col("edited_fingerprint")), "near_next": likeness(F.col("fingerprint"), F.col("following"))}
    return written(rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *(v.alias(name) for name, v in near.items())), "simhash")


def within(queries: DataFrame, found: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """(query, fingerprint, distance) of all pairs of distinct fingerprints at most ``radius`` bits apart.

    Both tables have a column ``fingerprint``. More blocks make longer keys and fewer chance meetings, but more tables:
    C(blocks, radius) of them. Nulls find nothing.
    """
    edges = [i * BITS // blocks for i in range(blocks + 1)]
    masks = [sum(((1 << edges[b + 1]) - (1 << edges[b])) for b in kept) for kept in combinations(range(blocks), blocks - radius)]
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]

    def tables(df: DataFrame, name: str) -> DataFrame:
        keys = F.array(*(F.col("fingerprint").bitwiseAND(F.lit(m).cast("long")) for m in signed))
        return df.select("fingerprint").filter("fingerprint is not null").distinct().select(F.col("fingerprint").alias(name), F.posexplode(keys).alias("table", "key"))

    met = tables(queries, "query").join(tables(found, "fingerprint"), ["table", "key"])
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint")))
    return met.select("query", "fingerprint", distance.alias("distance")).filter(F.col("distance") <= radius).distinct()
