"""Secret scans: three fixed patterns, and a pair of character Markov models for strings that look random.

DataFrame functions only. A token is random if a first-order Markov model of random strings explains its characters
better than one of ordinary identifiers: the log-likelihood ratio of its character pairs is at least a threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{12,}", "hex": r"[0-9a-f]{32,}"}
"""Fixed values. For ``access`` and ``hex``, asking for the length in the pattern finds what dropping short runs leaves."""
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = (*PATTERNS, "random")
WORDS = r"([A-Za-z]{3,})[^A-Za-z]+([A-Za-z]{3,})[^A-Za-z]+([A-Za-z]{3,})"
BLANK = "."
"""Stands for a character of a span that is found already; no token, access id or hex run holds it."""
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
WIDTH = len(ALPHABET) + 1
MARK = "[SECRET]"


def _found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _characters(token: Column) -> Column:
    """Places of a token's characters in ``ALPHABET``, 0 for others."""
    return F.transform(F.filter(F.split(token, ""), lambda c: c != ""), lambda c: F.instr(F.lit(ALPHABET), c))


def _cells(token: Column) -> Column:
    """One number for each pair of neighbouring characters."""
    places = _characters(token)
    n = F.greatest(F.size(places) - 1, F.lit(0))
    return F.zip_with(F.slice(places, F.lit(1), n), F.slice(places, F.lit(2), n), lambda a, b: a * WIDTH + b)


@dataclass(frozen=True)
class MarkovPair:
    """Log-likelihood ratios of character pairs, random over ordinary, in nats."""

    ratios: tuple[float, ...]

    def score(self, token: Column) -> Column:
        table = F.split(F.lit(" ".join(f"{x:.5f}" for x in self.ratios)), " ").cast("array<double>")
        return F.aggregate(_cells(token), F.lit(0.0), lambda total, cell: total + F.get(table, cell))


def labelled_samples(docs: DataFrame, text_col: str = "text", per_label: int = 20_000) -> DataFrame:
    """(token, label): at most ``per_label`` distinct tokens of each label, those of the smallest hash, from all texts.

    Random (1): what the fixed patterns find, and the digests of texts as hex and as base 64, which are random by
    construction. Ordinary (0): each text's first word of eight or more letters, and identifiers made of its first three
    neighbouring words: joined by ``_``, ``-`` or ``/``, in capitals, and with first
    letters in capitals and nothing between. Null and empty texts give
    digests of the empty text only; an empty table gives no sample.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    values = F.filter(F.transform(_found(text, ASSIGN), lambda m: F.regexp_extract(m, ASSIGN, 1)), lambda v: F.length(v) >= 8)
    digest = F.sha2(text.cast("binary"), 256)
    random = F.concat(values, _found(text, PATTERNS["access"]), _found(text, PATTERNS["hex"]), F.array(F.substring(digest, 1, 40), F.base64(F.unhex(digest))))
    words = [F.regexp_extract(text, WORDS, i) for i in (1, 2, 3)]
    ordinary = F.array(F.regexp_extract(text, r"[A-Za-z_]{8,}", 0), *(F.concat_ws(joint, *words) for joint in "_-/"), F.upper(F.concat_ws("_", *words)), F.concat(*map(F.initcap, words)))
    ordinary = F.filter(ordinary, lambda t: t.rlike("[A-Za-z]"))

    def labelled(tokens: Column, label: int) -> Column:
        # A lambda of two parameters would get the place in the array as the second.
        return F.transform(tokens, lambda t: F.struct(t.alias("token"), F.lit(label).alias("label")))

    rows = docs.select(F.explode(F.concat(labelled(random, 1), labelled(ordinary, 0))).alias("s"))
    distinct = rows.select("s.*").filter(F.length("token") >= 8).distinct()
    parts = [distinct.filter(F.col("label") == y).orderBy(F.xxhash64("token"), "token").limit(per_label) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def train(samples: DataFrame, smooth: float = 0.5, uniform: float = 0.0) -> MarkovPair:
    """Count character pairs of (token, label), whole tokens; the table has at most 2 x 69 x 69 rows, whatever the samples.

    ``smooth`` is added to each count. ``uniform`` is the share of a uniform choice of the next character in both models: it
    keeps what one pair that no sample has can say within bounds, also with many samples.
    """
    counted = samples.select("label", F.explode(_cells(F.col("token"))).alias("cell")).groupBy("label", "cell").count()
    counts = {(r["label"], r["cell"]): r["count"] for r in counted.collect()}
    ratios = []
    for a in range(WIDTH):
        rows = {y: [counts.get((y, a * WIDTH + b), 0) + smooth for b in range(WIDTH)] for y in (0, 1)}
        total = {y: sum(rows[y]) for y in (0, 1)}
        p = {y: [(1 - uniform) * n / total[y] + uniform / WIDTH for n in rows[y]] for y in (0, 1)}
        ratios += [math.log(r) - math.log(o) for r, o in zip(p[1], p[0], strict=True)]
    return MarkovPair(tuple(ratios))


def _is_random(token: Column, model: MarkovPair, threshold: float) -> Column:
    return token.rlike("[A-Za-z]") & (model.score(token) >= threshold)


def _kept(kind: str, model: MarkovPair, threshold: float):
    if kind == "assign":
        return lambda m: F.length(F.regexp_extract(m, ASSIGN, 1)) >= 8
    if kind == "random":
        return lambda m: _is_random(m, model, threshold)
    return lambda m: F.lit(True)


def scan(docs: DataFrame, model: MarkovPair, threshold: float = 10.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Find secrets in every whole text.

    Returns a row per input row: doc_id, n_assign, n_access, n_hex, n_random, base_spans and spans, arrays of (start,
    end, kind) by start, then kind as in ``KINDS``, in code points, the end exclusive. Random tokens are runs of 16 or more
    characters of ``TOKEN`` in what the patterns leave, as in ``redact``: the ratio of a shorter one can't be told from
    that of an ordinary name. Tokens of any length are scored whole. A null text counts as empty; null and repeated ids are
    rows like any other; an empty table gives an empty one; other columns, whatever their names, are not read. Rows are
    told apart by their place in the scan; only ids and places are shuffled, no texts.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), text.alias("text"))
    patterns = PATTERNS | {"random": TOKEN}
    left = F.col("text")
    for kind, pattern in PATTERNS.items():
        left = _replaced(left, pattern, _kept(kind, model, threshold), lambda m: F.repeat(F.lit(BLANK), F.length(m)))
    rows = rows.withColumn("left", left)
    searched = {k: F.col("left" if k == "random" else "text") for k in patterns}
    rows = rows.select("doc_id", "row", "text", "left", *(_found(searched[k], p).alias(k) for k, p in patterns.items()))
    kind_no = {k: i for i, k in enumerate(KINDS)}

    def places(kind: str) -> Column:
        gaps = F.split(searched[kind], patterns[kind], -1)
        keep = _kept(kind, model, threshold)
        pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(kind)), F.col(kind), lambda g, m: F.struct(F.lit(kind_no[kind]).alias("kind"), F.length(g).alias("gap"), F.length(m).alias("len"), keep(m).alias("keep")))
        return F.when(F.size(kind) > 0, pairs).otherwise(F.array().cast("array<struct<kind:int,gap:int,len:int,keep:boolean>>"))

    hits = rows.select("doc_id", "row", F.posexplode_outer(F.concat(*map(places, KINDS))).alias("pos", "hit")).repartition("row")
    in_order = Window.partitionBy("row", "hit.kind").orderBy("pos")
    ends = F.sum(F.col("hit.gap") + F.col("hit.len")).over(in_order).cast("int")
    spans = hits.select("doc_id", "row", "hit.kind", "hit.keep", (ends - F.col("hit.len")).alias("start"), ends.alias("end"))
    spans = spans.withColumn("random", F.col("kind") == kind_no["random"])
    base = F.col("keep") & ~F.col("random")
    before = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumns({"last_end": F.max(F.when(base, F.col("end"))).over(before), "next_start": F.min(F.when(base, F.col("start"))).over(after)})
    alone = F.coalesce(F.col("last_end") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next_start") >= F.col("end"), F.lit(True))
    kept = F.col("keep") & (~F.col("random") | alone)
    span = F.struct("start", "kind", "end")
    names = F.array(*map(F.lit, KINDS))

    def named(found: Column) -> Column:
        return F.transform(F.array_sort(found), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["kind"]).alias("kind")))

    return (
        spans.groupBy("row", "doc_id")
        .agg(
            *(F.count_if(kept & (F.col("kind") == i)).alias(f"n_{k}") for k, i in kind_no.items()),
            F.collect_list(F.when(kept & ~F.col("random"), span)).alias("base"),
            F.collect_list(F.when(kept, span)).alias("all"),
        )
        .select("doc_id", *(f"n_{k}" for k in KINDS), named(F.col("base")).alias("base_spans"), named(F.col("all")).alias("spans"))
    )


def _replaced(text: Column, pattern: str, keep: Callable[[Column], Column], by: Callable[[Column], Column]) -> Column:
    """The text with other text for the matches that ``keep`` names."""
    parts = F.zip_with(F.split(text, pattern, -1), _found(text, pattern), lambda gap, m: F.concat(gap, F.coalesce(F.when(m.isNotNull() & keep(m), by(m)).otherwise(m), F.lit(""))))
    return F.when(text.rlike(pattern), F.array_join(parts, "")).otherwise(text)


def redact(docs: DataFrame, model: MarkovPair, threshold: float = 10.0, text_col: str = "text") -> DataFrame:
    """Put ``MARK`` in place of every secret; other columns and clean texts stay as they are, nulls too.

    Kinds go one after the other, so that a random token is looked for in what the patterns leave. Rows without an id,
    repeated rows and an empty table stay what they are; columns are replaced by name, so others don't matter.
    """
    out = docs
    for kind, pattern in (PATTERNS | {"random": TOKEN}).items():
        out = out.withColumn(text_col, _replaced(F.col(text_col), pattern, _kept(kind, model, threshold), lambda m: F.lit(MARK)))
    return out


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
