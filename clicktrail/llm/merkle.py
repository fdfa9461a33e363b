"""Merkle manifests: a hash tree over the rows of each group, and one over the groups, with a proof for every row.

DataFrame functions only. Rows get their place in the group without a window over it: they are laid out in ranges of
(group, key), counted per range, and numbered from there. Per level, lag and lead columns of fixed offsets, masked by a
node's slot in its run and by the run's length, supply its siblings, and the first node of each run hashes the parent.
Windows cover one run each, so a group of any size is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clicktrail.sources.scratch import written

RUN = 16
MANIFEST_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<before: string, after: string>"


def _hash(text: Column) -> Column:
    return F.sha2(text, 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return _hash(F.concat(*map(encoded, values)))


def placed(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """Add ``pos``, a row's place from 0 in its group by ``order``, and ``n``, the rows of its group.

    Ranges of (group, order) are written with the number of each row; what is brought together is one count for each
    group in each range. Rows that are alike in all of ``order`` are dealt to several ranges too.
    """
    told = rows.withColumn("met", F.monotonically_increasing_id())
    ranged = told.repartitionByRange(group, *order, "met").sortWithinPartitions(group, *order, "met").drop("met")
    laid = written(ranged.withColumns({"range": F.spark_partition_id(), "at": F.monotonically_increasing_id()}), name)
    counts = laid.groupBy(group, "range").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    ranges = Window.partitionBy(group)
    before = F.coalesce(F.sum("rows").over(ranges.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(group, "range", (before - F.col("first")).alias("shift"), F.sum("rows").over(ranges).alias("n"))
    return laid.join(starts, [group, "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("range", "at", "shift")


def with_siblings(nodes: DataFrame) -> DataFrame:
    """Add ``run``, and the digests of the run's other nodes, joined: those ``before`` and those ``after`` the node."""
    in_run = Window.partitionBy("grp", "run").orderBy("pos")
    slot = F.pmod(F.col("pos"), F.lit(RUN)).cast("int")
    length = F.least(F.lit(RUN), F.col("n") - (F.col("pos") - slot)).cast("int")
    lags = [F.when(F.col("slot") >= k, F.lag("digest", k).over(in_run)) for k in range(RUN - 1, 0, -1)]
    leads = [F.when(F.col("slot") + k < F.col("length"), F.lead("digest", k).over(in_run)) for k in range(1, RUN)]
    # concat_ws leaves out nulls.
    return nodes.withColumns({"run": F.floor(F.col("pos") / RUN), "slot": slot, "length": length}).withColumns({"before": F.concat_ws("", *lags), "after": F.concat_ws("", *leads)})


def parents(nodes: DataFrame) -> DataFrame:
    """The next level: the first node of each run hashes the whole run. A group's only node stays as it is."""
    first = with_siblings(nodes).filter("slot = 0")
    digest = F.when(F.col("n") > 1, _hash(F.concat("digest", "after"))).otherwise(F.col("digest"))
    return first.select("grp", F.col("run").alias("pos"), F.ceil(F.col("n") / RUN).alias("n"), digest.alias("digest"))


def levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """All levels of all groups' trees as (grp, pos, n, digest), ``nodes`` first; the last has one node a group."""
    found = [nodes.select("grp", "pos", "n", "digest")]
    while (found[-1].agg(F.max("n")).first()[0] or 0) > 1:
        found.append(written(parents(found[-1]), f"{name}-level"))
    return found


def climb(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Add to nodes what their parents hold: ``path``, with the node's own siblings in front, and the rest of ``above``."""
    own = F.when(F.col("n") > 1, F.array(F.struct("before", "after"))).otherwise(F.array().cast(f"array<{STEP}>"))
    met = with_siblings(nodes).join(above.withColumnsRenamed({"pos": "run", "path": "upper"}), ["grp", "run"])
    return met.withColumn("path", F.concat(own, "upper")).drop("run", "slot", "length", "before", "after", "upper")


def paths(trees: list[DataFrame], top: DataFrame) -> DataFrame:
    """(grp, pos, path, ...) of the nodes of level 1 and, with one level, of level 0; ``top`` holds (grp, path, ...)."""
    found = trees[-1].select("grp", "pos").join(top, "grp")
    for nodes in reversed(trees[1:-1]):
        found = climb(nodes, found).drop("n", "digest")
    return found


def fold(digest: Column, path: Column) -> Column:
    """The root that a node's digest and its path lead to."""
    return F.aggregate(path, digest, lambda d, s: _hash(F.concat(s["before"], d, s["after"])))


def manifest(docs: DataFrame, columns: tuple[str, ...] = MANIFEST_COLUMNS, group_col: str = "source", id_col: str = "doc_id", text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """Leaf, root of the group's tree, root of all and proof of every row.

    A leaf hashes the row's ``columns``; other columns, whatever their names, take no part. Within a group, leaves stand
    by id, null first, then by digest; groups stand by name, null first, bytewise. While more than one node is left,
    every 16 in a row become their hash, the last run as it is. The group's last node is its ``subroot``; subroots become
    ``root`` the same way. ``path`` holds the siblings before and after, level by level; ``proof_sha256`` hashes them all.
    Where ``tampered`` holds, the text's A-Z are lower-cased and ``folded_root`` is folded from the leaf of that; else from
    the row's own. ``verified`` says whether that is the root; a tampered text without A-Z verifies, as nothing changed.

    Returns a row per input row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, path. Null and repeated
    ids, rows that stand twice and null cells are hashed as they are; an empty table gives an empty result. A text of any
    length is hashed where it is read and never shuffled.
    """
    changed = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    values = [F.col(c) for c in columns]
    other = leaf_of(*(lower if c == text_col else F.col(c) for c in columns))
    leaf = leaf_of(*values)
    # "-" sorts before "=", so a null group comes first.
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))
    rows = docs.select(group.alias("grp"), F.col(id_col).alias("doc_id"), leaf.alias("digest"), F.when(changed, other).alias("forged"))
    # Hashed and written before the ranges are sampled, so that texts are read once.
    rows = written(rows, "merkle-rows")
    leaves = written(placed(rows, "grp", ["doc_id", "digest"], "merkle-leaves"), "merkle-placed")
    trees = levels(leaves, "merkle")
    subroots = trees[-1].select("grp", F.col("digest"))
    named = subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest")
    tops = written(placed(named, "grp", ["name"], "merkle-groups"), "merkle-subroots")
    upper = levels(tops, "merkle-top")
    last = upper[-1].select("digest").first()
    root = F.lit(last["digest"] if last else None).cast("string").alias("root")
    ends = upper[-1].select("grp", F.array().cast(f"array<{STEP}>").alias("path")).distinct()
    over = paths(upper, ends)
    if len(upper) > 1:
        over = climb(tops, over)
    else:
        over = tops.join(over.drop("pos"), "grp")
    top = over.select(F.col("name").alias("grp"), "path", F.col("digest").alias("subroot"))
    above = paths(trees, top)
    found = climb(leaves, above) if len(trees) > 1 else leaves.join(above.drop("pos"), "grp")
    proof = F.array_join(F.transform("path", lambda s: F.concat(s["before"], s["after"])), "")
    given = F.coalesce("forged", "digest")
    folded = found.select("doc_id", F.col("digest").alias("leaf"), "subroot", root, _hash(proof).alias("proof_sha256"), fold(given, F.col("path")).alias("folded_root"), "path")
    return folded.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"), "path")
