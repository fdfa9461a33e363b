"""Merkle manifests against a plain Python tree, and against DuckDB."""

import hashlib
import zlib

from pyspark.sql import functions as F

from checks.compare import database, spark_rows, sql_rows
from clicktrail.llm import queries
from clicktrail.llm.merkle import manifest
from tests.llm.conftest import CLASHING, TABLES


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    cells = ["-" if c is None else f"{len(str(c).encode())}:{c}" for c in row]
    return h("".join(cells))


def tree(digests):
    """Root, and for each leaf its siblings before and after, level by level."""
    paths, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        for i, a in enumerate(at):
            start = a - a % 16
            paths[i].append(("".join(level[start:a]), "".join(level[a + 1 : start + 16])))
        level = [h("".join(level[a : a + 16])) for a in range(0, len(level), 16)]
        at = [a // 16 for a in at]
    return level[0], paths


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def by_hand(rows, forged):
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = tree([leaf(r) for r in groups[name]])
    root, tops = tree([trees[n][0] for n in names]) if names else (None, [])
    out = []
    for n, top in zip(names, tops, strict=True):
        for r, path in zip(groups[n], trees[n][1], strict=True):
            whole = path + top
            d = leaf((*r[:4], lowered(r[4]))) if forged(r[0]) else leaf(r)
            for before, after in whole:
                d = h(before + d + after)
            out.append((r[0], leaf(r), trees[n][0], root, h("".join(b + a for b, a in whole)), d, d == root))
    return sorted(out, key=str)


def crc(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def got(spark, rows, schema=SCHEMA):
    docs = spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in [*CLASHING, "grp", "digest", "slot", "run", "path", "root", "before", "after", "length", "name"]})
    made = manifest(docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    return sorted((tuple(r) for r in made.drop("path").collect()), key=str)


def test_given_documents_by_hand(spark, documents):
    rows = [tuple(r) for r in documents.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted((tuple(r) for r in queries.row_manifest(spark, TABLES).collect()), key=str) == by_hand(rows, crc)


def test_given_documents_in_sql(spark):
    assert spark_rows(queries.row_manifest(spark, TABLES)) == sql_rows(database(TABLES), queries.oracle_sql()["op12_merkle"])


def test_odd_rows(spark):
    rows = [(i, f"s{i % 3}" if i % 5 else None, None if i % 7 == 0 else "en", i, ("Aa Ü 日本 " * (i % 4)) if i % 6 else None) for i in range(300)]
    rows += [(None, "s1", "en", None, "No id"), (None, None, None, None, None), (7, "s1", "en", 7, "again"), (7, "s1", "en", 7, "again")]
    rows += [(500, "", "en", 1, "X"), (501, "-", "en", 1, "y"), (502, "Ünï", None, 1, "Z" * 300_000), (503, "lone", None, 1, "")]
    assert got(spark, rows) == by_hand(rows, crc)


def test_sizes_around_a_run(spark):
    for n in (1, 2, 16, 17, 33, 257):
        rows = [(i, "a", "en", 1, f"T{i}") for i in range(n)]
        assert got(spark, rows) == by_hand(rows, crc), n
    many = [(i, f"s{i:03}", "en", 1, "T") for i in range(40)]
    assert got(spark, many) == by_hand(many, crc)
    assert got(spark, []) == []


def test_one_row_many_times(spark):
    rows = [(5, "a", "en", 1, "Same")] * 700 + [(6, "b", "en", 1, "Other")]
    assert got(spark, rows) == by_hand(rows, crc)


def test_another_key_and_nothing_tampered(spark):
    docs = spark.createDataFrame([(1, "x", "A"), (2, "x", "B")], "page long, host string, body string")
    made = manifest(docs, columns=("page", "body"), group_col="host", id_col="page", text_col="body").collect()
    digests = [leaf((1, "A")), leaf((2, "B"))]
    assert [r.leaf for r in sorted(made)] == digests and all(r.verified and r.root == h("".join(digests)) for r in made)
