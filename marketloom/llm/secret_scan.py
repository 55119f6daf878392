"""Secret scans over an incremental blob ledger.

Every version of every path is content-addressed (SHA-256 of its text). The ledger is a Parquet table of (blob, rule, rule
version) with the spans found there. An update takes one text per address, keeps the blobs of which some current
rule version has not been scanned, scans only those pairs and appends them. Findings are joined back to all paths of
a blob, so copies and unchanged versions cost an address, not a scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.tables import filled, settled, table
from marketloom.session import fresh_path


@dataclass(frozen=True)
class Rule:
    """A pattern; a match counts when ``group`` of it has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    any_case: bool = False
    group: int = 0
    least: int = 0


# Fixed values of the contract; kinds in the order in which equal starts are listed. A run of hex digits is matched whole or
# not at all, so its least length can stand in the pattern.
RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", any_case=True, group=2, least=6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)

LEDGER = "blob_id binary, rule string, version int, spans array<struct<start:int,end:int>>"


def spans_of(rule: Rule, text: str, compiled: dict[Rule, re.Pattern]) -> list[tuple[int, int]]:
    return [m.span() for m in compiled[rule].finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]


def scanned(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows for ``blobs`` (``blob_id, text, todo``: the rules to apply)."""

    def scan(batches: Iterator) -> Iterator:
        import pandas as pd

        compiled = {rule: re.compile(rule.pattern, re.ASCII | (re.IGNORECASE if rule.any_case else 0)) for rule in rules}
        for batch in batches:
            rows = []
            for blob, text, todo in zip(batch["blob_id"], batch["text"], batch["todo"]):
                for rule in rules:
                    if rule.kind in todo:
                        spans = [{"start": a, "end": b} for a, b in spans_of(rule, text, compiled)]
                        rows.append((blob, rule.kind, rule.version, spans))
            yield pd.DataFrame(rows, columns=["blob_id", "rule", "version", "spans"])

    return blobs.mapInPandas(scan, LEDGER)


def addressed(versions: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``blob_id``, the SHA-256 of the UTF-8 text (null as empty)."""
    return versions.withColumn("blob_id", F.unhex(F.sha2(filled(text).cast("binary"), 256)))


def _current(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    wanted = F.lit(False)
    for rule in rules:
        wanted = wanted | ((F.col("rule") == rule.kind) & (F.col("version") == rule.version))
    return ledger.where(wanted)


def update(versions: DataFrame, ledger_path: str, *, text: str = "text", rules: tuple[Rule, ...] = RULES, first: bool = False) -> int:
    """Scan what the ledger lacks and append it; ``first`` starts a new ledger. Returns the number of pairs scanned."""
    spark = versions.sparkSession
    blobs = addressed(versions, text).groupBy("blob_id").agg(F.first(filled(text)).alias("text"))
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    if first:
        blobs = blobs.withColumn("todo", kinds)
        before = 0
    else:
        ledger = spark.read.schema(LEDGER).parquet(ledger_path)
        before = ledger.count()
        seen = _current(ledger, rules).groupBy("blob_id").agg(F.collect_set("rule").alias("seen"))  # at most one per rule
        unseen = F.array_except(kinds, F.coalesce("seen", F.array().cast("array<string>")))
        blobs = blobs.join(seen, "blob_id", "left").withColumn("todo", unseen).drop("seen").where(F.size("todo") > 0)
    scanned(blobs, rules).write.mode("append").parquet(ledger_path)
    return spark.read.schema(LEDGER).parquet(ledger_path).count() - before


def findings(paths: DataFrame, ledger_path: str, *, text: str = "text", rules: tuple[Rule, ...] = RULES, columns: list[str]) -> DataFrame:
    """One row per row of ``paths``: ``columns`` and ``found``, an array of (start, order of the kind, end, kind) in order.

    Null and empty texts have no findings; repeated rows and copies all get their blob's. Only ``columns`` and the text are
    read from ``paths``; a column named ``found`` among them is an error of Spark's (ambiguous), other names cannot clash.
    """
    order = F.create_map(*[x for i, rule in enumerate(rules) for x in (F.lit(rule.kind), F.lit(i))])
    ledger = _current(paths.sparkSession.read.schema(LEDGER).parquet(ledger_path), rules)
    ranked = ledger.select("blob_id", F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), order[F.col("rule")].alias("rank"), s["end"].alias("end"), F.col("rule").alias("kind"))).alias("spans"))
    by_blob = settled(ranked.groupBy("blob_id").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("found")), "blob-findings")
    held = addressed(paths.select(F.struct(*columns).alias("path"), F.col(text).alias("text"))).select("path", "blob_id")
    return held.join(by_blob, "blob_id").select("path.*", "found")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ledger = table(spark, sf_dir, "documents"), fresh_path(spark, "blob-ledger")
    update(docs, ledger, first=True)
    found = findings(docs, ledger, columns=["doc_id"])
    said = F.array_join(F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    counts = [count(rule.kind) for rule in RULES]
    return found.select("doc_id", *counts, F.sha2(said.cast("binary"), 256).alias("base_sha256"), said.alias("spans"))
