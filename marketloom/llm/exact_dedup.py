"""Exact dedup by distributed MSD radix partitioning.

All documents start in one group. A round splits every open group by its documents' next digit, a run of successive
bytes: one aggregate counts the documents per (group, digit), combining on the map side so that a hot group arrives as
one partial row per task. A group is settled when it has one member or when its digit is shorter than the round's
width, which means that the texts have ended and are equal byte by byte; no digest decides equality. Documents of open
groups go to the next round with a wider digit, so the number of rounds grows with the logarithm of the longest repeated
text. Only the first round moves every text once; later rounds move copies and texts with a long common beginning.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.tables import filled, settled, table

FIRST_WIDTH = 256  # bytes of the first digit: few different texts still agree there
WIDER = 8  # factor from one digit to the next
WIDEST = 1 << 20


def radix_groups(
        docs: DataFrame, *, key: str = "doc_id", text: str = "text", carry: list[str] | None = None, with_text: bool = False,
        first_width: int = FIRST_WIDTH) -> DataFrame:
    """Groups of documents with equal texts; one row per input row.

    Result: ``key_id``, ``keep_id`` (largest key of the group), ``group_size``, ``kept``, ``text_sha256``, ``level`` and
    ``label`` (together unique per group), ``doc`` (struct of the columns named in ``carry``) and ``body`` (the text's
    UTF-8 bytes, with ``with_text`` on kept rows, else null).

    Null text counts as empty. A null key never is the largest; a group without any key keeps its rows. Rows that repeat a
    key and a text are one document said twice and share its verdict (``kept_rows`` leaves one of them). An empty table
    gives no rows. Input columns are read into ``doc``, so their names cannot clash with the result's.
    """
    held = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.lit(None).cast("string")
    rows = docs.select(
        F.col(key).alias("key_id"), held.alias("doc"), filled(text).cast("binary").alias("body"), F.lit(0).cast("bigint").alias("label"))
    start, width, level, done = 0, first_width, 0, []
    while True:
        digit = F.substring(F.col("body"), start + 1, width)
        rows = rows.withColumn("digit", digit)
        counted = rows.groupBy("label", "digit").agg(F.count(F.lit(1)).alias("group_size"), F.max("key_id").alias("keep_id"))
        counted = settled(counted.withColumn("next_label", F.monotonically_increasing_id()), "radix-groups")
        ended = (F.col("group_size") == 1) | (F.length("digit") < width)
        kept = F.col("key_id").eqNullSafe(F.col("keep_id"))
        moved = ~ended | kept if with_text else ~ended
        split = settled(rows.join(counted, ["label", "digit"]).select(
            "key_id", "keep_id", "group_size", kept.alias("kept"), F.sha2("body", 256).alias("text_sha256"), F.lit(level).alias("level"),
            F.col("next_label").alias("label"), "doc", F.when(moved, F.col("body")).alias("body"), ended.alias("ended")), "radix-rows")
        done.append(split.where("ended").drop("ended"))
        rows = split.where("NOT ended").select("key_id", "doc", "body", "label")
        if rows.isEmpty():
            return reduce(DataFrame.unionByName, done)
        start, width, level = start + width, min(width * WIDER, WIDEST), level + 1


def kept_rows(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that stay, with all their columns; one row per group, even where rows repeat a key and a text."""
    others = [c for c in docs.columns if c != text]
    groups = radix_groups(docs, key=key, text=text, carry=others, with_text=True).where("kept")
    columns = [F.col("body").cast("string").alias(text) if c == text else F.col(f"doc.`{c}`").alias(c) for c in docs.columns]
    repeated = groups.where("group_size > 1").dropDuplicates(["level", "label"])
    return groups.where("group_size = 1").unionByName(repeated).select(*columns)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = radix_groups(table(spark, sf_dir, "documents"))
    return groups.select(F.col("key_id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
