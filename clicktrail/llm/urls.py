"""URL filter: explicit rules first, gradient-boosted trees on lexical features for the rest.

DataFrame functions only; the trees are Spark ML's.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SUFFIX_BUCKETS = 1024
SUFFIXES = ("tld", "domain", "first_step", "file_type")
FEATURES = (
    "length",
    "host_length",
    "path_length",
    "depth",
    "labels",
    "digit_ratio",
    "host_digit_ratio",
    "hyphens",
    "symbols",
    "entropy",
    "host_entropy",
    "params",
    "query_length",
    "has_fragment",
    "secure",
    *(f"{s}_{x}" for s in SUFFIXES for x in ("rate", "weight")),
)


@dataclass(frozen=True)
class Rule:
    """``block`` or ``allow`` a host with its subdomains, where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(_after_scheme(url), "#", 1)).otherwise("")
    return F.coalesce(F.translate(F.substring_index(F.substring_index(rest, "?", 1), "/", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.substring_index(F.substring_index(_after_scheme(url), "#", 1), "?", 1)
    return F.coalesce(F.when((F.instr(url, "://") > 0) & (F.instr(rest, "/") > 0), rest.substr(F.instr(rest, "/"), F.length(rest))).otherwise(""), F.lit(""))


def _after_scheme(url: Column) -> Column:
    return url.substr(F.instr(url, "://") + 3, F.length(url))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(text, verdict) of the longest rule that fits, the earlier of two as long; null where none does."""
    text = verdict = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: len(r.text)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        text, verdict = F.when(fits, r.text).otherwise(text), F.when(fits, r.verdict).otherwise(verdict)
    return text, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def _ratio(part: Column, whole: Column) -> Column:
    return part / F.greatest(whole, F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits per character, from the runs of the sorted characters."""

    def closed(a: Column) -> Column:
        return a["total"] + F.when(a["run"] > 0, a["run"] * F.log2(a["run"])).otherwise(0.0)

    def follow(a: Column, c: Column) -> Column:
        same = a["last"] == c
        run, total = F.when(same, a["run"] + 1).otherwise(1.0), F.when(same, a["total"]).otherwise(closed(a))
        return F.struct(c.alias("last"), run.alias("run"), total.alias("total"), (a["n"] + 1).alias("n"))

    letters = F.sort_array(F.filter(F.split(text, ""), lambda c: c != ""))
    start = F.struct(F.lit("").alias("last"), *(F.lit(0.0).alias(x) for x in ("run", "total", "n")))
    return F.aggregate(letters, start, follow, lambda a: F.when(a["n"] > 0, F.greatest(F.log2(a["n"]) - closed(a) / a["n"], F.lit(0.0))).otherwise(0.0))


def lexical(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host``, ``path``, the lexical features and the four suffixes. A null URL counts as empty.

    Entropy is taken over the characters of the whole URL or host, whatever its length.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    df = urls.withColumn("host", host_of(url)).withColumn("path", path_of(url))
    host, path = F.col("host"), F.col("path")
    query = F.when(F.instr(url, "?") > 0, F.substring_index(url.substr(F.instr(url, "?") + 1, F.length(url)), "#", 1)).otherwise("")
    return df.select(
        "*",
        F.length(url).alias("length"),
        F.length(host).alias("host_length"),
        F.length(path).alias("path_length"),
        _count(path, "/").alias("depth"),
        _count(host, r"\.").alias("labels"),
        _ratio(_count(url, "[0-9]"), F.length(url)).alias("digit_ratio"),
        _ratio(_count(host, "[0-9]"), F.length(host)).alias("host_digit_ratio"),
        _count(url, "-").alias("hyphens"),
        _count(url, r"[^A-Za-z0-9/.:-]").alias("symbols"),
        _entropy(url).alias("entropy"),
        _entropy(host).alias("host_entropy"),
        F.when(query == "", 0).otherwise(_count(query, "&") + 1).alias("params"),
        F.length(query).alias("query_length"),
        (F.instr(url, "#") > 0).cast("int").alias("has_fragment"),
        url.startswith("https:").cast("int").alias("secure"),
        F.substring_index(host, ".", -1).alias("tld"),
        F.substring_index(host, ".", -2).alias("domain"),
        F.get(F.split(path, "/", 3), 1).alias("first_step"),
        F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})/?$", 1).alias("file_type"),
    )


def _bucket(name: str) -> Column:
    return F.pmod(F.xxhash64(F.lit(name), F.coalesce(F.col(name), F.lit(""))), F.lit(SUFFIX_BUCKETS)).cast("int")


@dataclass
class UrlModel:
    """Trees, and for each kind of suffix the share and number of blocked URLs in ``SUFFIX_BUCKETS`` hashed buckets."""

    trees: GBTClassificationModel
    rates: dict[str, list[float]]
    weights: dict[str, list[float]]

    def features(self, df: DataFrame) -> DataFrame:
        def of(values: list[float], name: str) -> Column:
            table = F.split(F.lit(" ".join(f"{v:.6g}" for v in values)), " ").cast("array<double>")
            return F.get(table, _bucket(name))

        stats = {f"{s}_rate": of(self.rates[s], s) for s in SUFFIXES} | {f"{s}_weight": of(self.weights[s], s) for s in SUFFIXES}
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df.withColumns(stats))

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``score``, the probability of ``block``, to what ``lexical`` gave."""
        scored = self.trees.transform(self.features(df))
        return scored.withColumn("score", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def train(labelled: DataFrame, max_rows: int = 20_000, trees: int = 15, depth: int = 4) -> UrlModel:
    """Fit on what ``lexical`` gave, with ``label`` 1 for URLs to block and 0 for others.

    Suffix statistics count all labelled rows; the trees are fitted on at most ``max_rows``, those of the smallest hash.
    Without labelled rows of both kinds there is nothing to learn: a ``ValueError`` is raised.
    """
    counted = labelled.select("label", F.explode(F.array(*(F.struct(F.lit(s).alias("kind"), _bucket(s).alias("bucket")) for s in SUFFIXES))).alias("at"))
    rows = counted.groupBy("at.kind", "at.bucket").agg(F.sum("label").alias("blocked"), F.count("*").alias("n")).collect()
    total, blocked = (sum(r[x] for r in rows if r["kind"] == SUFFIXES[0]) for x in ("n", "blocked"))
    if not 0 < blocked < total:
        raise ValueError("both kinds of labelled URLs are needed")
    prior, smooth = blocked / total, 5.0
    rates = {s: [prior] * SUFFIX_BUCKETS for s in SUFFIXES}
    weights = {s: [0.0] * SUFFIX_BUCKETS for s in SUFFIXES}
    for r in rows:
        rates[r["kind"]][r["bucket"]] = (r["blocked"] + smooth * prior) / (r["n"] + smooth)
        weights[r["kind"]][r["bucket"]] = r["n"] / total
    model = UrlModel(None, rates, weights)
    sample = labelled.orderBy(F.xxhash64("host", "path", "length")).limit(max_rows).repartition(12)
    fitted = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=7)
    return UrlModel(fitted.fit(model.features(sample).select("features", F.col("label").cast("double").alias("label"))), rates, weights)


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """Judge every URL: by the longest rule that fits, else by trees trained on the URLs that a rule decides.

    Returns a row per input row: page_id, host, path, rule, verdict, score. A null URL, or one without ``://``, has an
    empty host and path and is left to the trees. Repeated rows and ids stay. Where the rules label no URL of one of
    the kinds, all others get the verdict of the other kind (``allow`` where there is none), and score is null.
    """
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    seen = lexical(urls)
    text, verdict = rule_for(F.col("host"), F.col("path"), rules)
    seen = seen.withColumns({"rule": text, "given": verdict})
    labelled = seen.filter("given is not null").withColumn("label", (F.col("given") == "block").cast("int"))
    try:
        scored = train(labelled).score(seen)
        learned = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    except ValueError:
        first = labelled.select("given").first()
        scored = seen.withColumn("score", F.lit(None).cast("double"))
        learned = F.lit(first["given"] if first else "allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("given", learned).alias("verdict"), "score")
