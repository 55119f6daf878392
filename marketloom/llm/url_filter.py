"""URL filters: rules first, then gradient-boosted trees on lexical features.

Everything is DataFrame expressions and Spark's own tree boosting. Labelled URLs are pages whose path names a labelled document; a URL of
a low-quality document is one to block. The fit takes a bounded sample of them; scoring is a map over all URLs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.tables import filled, settled, table

SAMPLE = 20_000  # labelled URLs that fit the trees and the suffix statistics, the first by a hash
SEED = 41
TREES, DEPTH = 10, 4
PRIOR = 20.0  # labelled URLs by which a suffix's block rate leans to the overall one
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    prefix: str  # host, then the beginning of the path

    @property
    def host(self) -> str:
        return self.prefix.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.prefix.split("/", 1)[1]


# Fixed values of the contract.
RULES = (
    Rule("allow", "org/"), Rule("block", "example.org/es/"), Rule("block", "example.org/en/1"), Rule("allow", "com/fr/"), Rule("block", "com/de/"))

FEATURES = [
    "length", "host_length", "path_length", "depth", "labels", "hyphens", "digit_ratio", "host_digits", "entropy", "parameters", "query_length",
    "has_fragment", "secure", "suffix_seen", "suffix_rate"]


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z as a-z; empty for null or without ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(_rest(url), F.lit("")), "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Prefix of the longest rule that fits the host, or a domain above it, and the path; ties by text. Null if none fits."""
    cases = [F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.lit(r.prefix))
             for r in sorted(rules, key=lambda r: (-len(r.prefix), r.prefix))]
    return F.coalesce(*cases, F.lit(None).cast("string"))


def _count(text: Column, sign: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sign), F.lit("")))


def _entropy(text: Column) -> Column:
    """Bits per character."""
    size = F.length(text).cast("double")
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.when(c == "", 0.0).otherwise((size - F.length(F.replace(text, c, F.lit("")))) / size))
    return F.when(size == 0, 0.0).otherwise(F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0)))


def suffix_of(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(host, ".", -2)


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the features that need nothing but ``url``, ``host`` and ``path``."""
    url, host, path = filled("url"), F.col("host"), F.col("path")
    digits = F.length(F.regexp_replace(url, "[^0-9]", ""))
    query = F.regexp_extract(url, "^[^?#]*[?]([^#]*)", 1)
    return urls.select(
        "*", F.length(url).cast("double").alias("length"), F.length(host).cast("double").alias("host_length"),
        F.length(path).cast("double").alias("path_length"), _count(path, "/").cast("double").alias("depth"),
        _count(host, ".").cast("double").alias("labels"), _count(url, "-").cast("double").alias("hyphens"),
        F.when(F.length(url) == 0, 0.0).otherwise(digits / F.length(url)).alias("digit_ratio"),
        F.length(F.regexp_replace(host, "[^0-9]", "")).cast("double").alias("host_digits"), _entropy(url).alias("entropy"),
        F.when(query == "", 0.0).otherwise(_count(query, "&") + 1.0).alias("parameters"), F.length(query).cast("double").alias("query_length"),
        (F.instr(url, "#") > 0).cast("double").alias("has_fragment"), F.translate(url, UPPER, LOWER).startswith("https://").cast("double").alias("secure"),
        suffix_of(host).alias("suffix"))


def labelled_urls(pages: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """``url, blocked`` (1.0 or 0.0) for at most ``size`` pages whose path names a labelled document."""
    named = F.expr("try_cast(regexp_extract(url, '://[^/?#]*/(?:[^0-9?#][^/?#]*/)*([0-9]+)', 1) AS bigint)")
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    found = pages.select("page_id", "url", named.alias("doc_id")).join(known, "doc_id")
    first = found.orderBy(F.xxhash64("url", F.lit(SEED)), "url", "page_id").limit(size)
    return first.select("url", (F.col("quality") == 0).cast("double").alias("blocked"))


def with_suffix(features: DataFrame, statistics: DataFrame, overall: float) -> DataFrame:
    """Adds how many labelled URLs share the suffix, and their smoothed block rate."""
    joined = features.join(F.broadcast(statistics), "suffix", "left")  # at most SAMPLE rows
    return joined.withColumns({"suffix_seen": F.coalesce("seen", F.lit(0.0)), "suffix_rate": F.coalesce("rate", F.lit(overall))}).drop("seen", "rate")


def _addressed(urls: DataFrame) -> DataFrame:
    return urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})


def scorer(labelled: DataFrame):
    """A function that adds ``blocked_by_trees`` to rows with ``url``, ``host`` and ``path``. Without both kinds of labels nothing is blocked."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    known = settled(lexical(_addressed(labelled)), "labelled-urls")
    total, bad = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
    if bad == 0 or bad == total:
        return lambda urls: urls.withColumn("blocked_by_trees", F.lit(False))
    overall = bad / total
    statistics = settled(known.groupBy("suffix").agg(
        F.count(F.lit(1)).cast("double").alias("seen"),
        ((F.sum("blocked") + overall * PRIOR) / (F.count(F.lit(1)) + PRIOR)).alias("rate")), "suffix-statistics")
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
    training = assembler.transform(with_suffix(known, statistics, overall)).select("features", "blocked")
    trees = GBTClassifier(
        labelCol="blocked", maxIter=TREES, maxDepth=DEPTH, seed=SEED, checkpointInterval=-1).fit(training)

    def score(urls: DataFrame) -> DataFrame:
        judged = trees.transform(assembler.transform(with_suffix(lexical(urls), statistics, overall)))
        return judged.select(*urls.columns, (F.col("prediction") == 1.0).alias("blocked_by_trees"))

    return score


def judged(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict``, one row per page.

    A null url, or one without ``://``, has empty host and path and is judged by the trees. Repeated rows get the same verdict.
    No pages give no rows. Only ``page_id`` and ``url`` are read, so other columns cannot clash.
    """
    read = _addressed(pages.select("page_id", "url"))
    scored = scorer(labelled_urls(pages, labels))(read)
    scored = scored.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    by_rule = F.coalesce(*[F.when(F.col("rule") == r.prefix, F.lit(r.verdict)) for r in rules])
    verdict = F.coalesce(by_rule, F.when(F.col("blocked_by_trees"), F.lit("block")).otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
