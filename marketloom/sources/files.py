"""File readers and writers of the model's datasets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketloom import spec
from marketloom.functions import periods as P
from marketloom.functions import text as X

ENVELOPES = ("rows", "data", "items")


def read_json_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON files holding either an array of records or one object with the records under rows, data or items."""
    known = set(schema.fieldNames())
    lists = [T.StructField(n, T.ArrayType(schema)) for n in ENVELOPES if n not in known]
    raw = spark.read.schema(T.StructType([*schema.fields, *lists])).option("multiLine", True).json(path)
    packed = F.coalesce(*[F.col(f.name) for f in lists], F.array(F.struct(*schema.fieldNames())))
    return raw.select(F.inline(packed))


def read_periods(spark: SparkSession, path: str, period: str | None = None) -> DataFrame:
    """Statement warehouse, one directory per period; a period filter prunes directories. An unreadable file fails the job."""
    rows = spark.read.parquet(path)
    return rows if period is None else rows.where(F.col("period") == period)


def newest_value(df: DataFrame, column: str) -> DataFrame:
    """Rows of the newest partition value, e.g. the newest snapshot of a table. The maximum is a scalar subquery that
    prunes partitions; nothing is fetched to the driver."""
    newest = df.agg(F.max(column)).scalar()
    return df.where(F.col(column) == newest)


@F.pandas_udf(T.StringType())
def _decode_other(content: pd.Series) -> pd.Series:
    """Bytes that are not UTF-8: GBK, else UTF-8 with replacement. Python because the JVM decoder never fails over."""

    def one(raw: bytes | None) -> str | None:
        if raw is None:
            return None
        try:
            return bytes(raw).decode("gbk")
        except UnicodeDecodeError:
            return bytes(raw).decode("utf-8", errors="replace")

    return content.map(one)


def decode_text(content: str | Column) -> Column:
    """Bytes to text: UTF-8, then GBK, then UTF-8 with replacement. Only bytes that are not UTF-8 leave the JVM."""
    raw = F.col(content) if isinstance(content, str) else content
    plain = F.is_valid_utf8(raw.cast("string"))
    return F.when(plain, raw.cast("string")).otherwise(_decode_other(F.when(~plain, raw)))


def read_text_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of small configuration files in unknown encoding, with their position."""
    raw = spark.read.format("binaryFile").load(path).select("path", decode_text("content").alias("text"))
    return raw.select("path", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "line")).where(F.trim("line") != "")


@F.pandas_udf(T.StringType())
def decode_field(content: pd.Series, encoding: pd.Series) -> pd.Series:
    """Bytes up to the first NUL as text; undecodable bytes are skipped, which the JVM decoders cannot do."""
    return pd.Series([bytes(c).split(b"\0", 1)[0].decode(e, errors="ignore").strip() for c, e in zip(content, encoding)])


def decode_master(files: DataFrame) -> DataFrame:
    """Security master records from (market, content) rows: a header, then fixed-width records.

    The JVM cuts the records and keeps those with a six-digit symbol; only the names' bytes go to Python.
    """
    size = spec.MASTER_RECORD
    count = F.floor((F.octet_length("content") - spec.MASTER_HEADER) / size)
    starts = F.when(count > 0, F.sequence(F.lit(0).cast("bigint"), count - 1)).otherwise(F.array().cast("array<bigint>"))
    record = F.transform(starts, lambda i: F.substring(F.col("content"), (i * size + spec.MASTER_HEADER + 1).cast("int"), F.lit(size)))
    rows = files.select("market", F.explode(record).alias("r"))
    rows = rows.where(F.hex(F.substring("r", 1, 6)).rlike("^(3[0-9]){6}$"))

    def field(at: int, width: int, encoding: str) -> Column:
        return decode_field(F.substring("r", at + 1, width), F.lit(encoding))

    out = rows.select(
        "market", F.decode(F.substring("r", 1, 6), "US-ASCII").alias("symbol"), field(*spec.MASTER_NAME).alias("stock_name"),
        F.lower(field(*spec.MASTER_INITIALS)).alias("name_initials"))
    return out.where(F.col("stock_name") != "")


def read_master(spark: SparkSession, path: str) -> DataFrame:
    """Security master files named by exchange; of duplicates the first by name stays and ineligible names leave."""
    files = spark.read.format("binaryFile").load(path)
    name = F.try_element_at(F.split("path", "/"), F.lit(-1))
    rows = decode_master(files.select(F.substring(name, 1, 2).alias("market"), "content"))
    eligible = rows.where(X.is_a_share_eligible(F.col("symbol"), F.col("stock_name")))
    return eligible.groupBy("market", "symbol").agg(F.min(F.struct("stock_name", "name_initials")).alias("r")).select("market", "symbol", "r.*")


def with_package_date(rows: DataFrame) -> DataFrame:
    """Report date from the package name in the file path."""
    return rows.withColumn("package_date", F.regexp_extract(F.col("_metadata.file_path"), r"gpcw(\d{8})", 1))


ITEM = "array<struct<item_title:string,item_value:double>>"
REPORTS = f"map<string,struct<publish_date:string,tables:struct<lrb:{ITEM},zcfz:{ITEM},llb:{ITEM}>>>"


def flatten_reports(payloads: DataFrame) -> DataFrame:
    """(code, JSON of reports by date) to long rows (code, period, publish_date, title, value), titles by table."""
    reports = payloads.select("code", F.explode(F.from_json("payload", REPORTS)).alias("date", "report"))
    rows = reports.select(
        "code", P.period_from_yyyymmdd(F.col("date").try_cast("int")).alias("period"), F.col("report.publish_date").alias("publish_date"),
        F.explode(F.array(*[F.struct(F.lit(t).alias("source"), F.col(f"report.tables.{t}").alias("items")) for t in ("lrb", "zcfz", "llb")])).alias("t"))
    items = rows.select("code", "period", "publish_date", F.col("t.source").alias("source"), F.inline("t.items"))
    return items.where((F.col("item_title") != "") & F.col("item_value").isNotNull()).select(
        "code", "period", "publish_date", F.concat_ws("_", "source", "item_title").alias("title"), F.col("item_value").alias("value"))


def pivot_reports(long: DataFrame, titles: list[str]) -> DataFrame:
    """One wide row per code and period; the column list is given, so no pass is spent on finding it."""
    return long.groupBy("code", "period").pivot("title", titles).agg(F.first("value"))


def newest_with_income(payloads: DataFrame) -> DataFrame:
    """Newest period per code that has an income statement; its other tables default to empty."""
    reports = payloads.select("code", F.explode(F.from_json("payload", REPORTS)).alias("date", "report"))
    usable = reports.where(F.size("report.tables.lrb") > 0).withColumn("period", P.period_from_yyyymmdd(F.col("date").try_cast("int")))
    size = lambda t: F.coalesce(F.nullif(F.size(f"report.tables.{t}"), F.lit(-1)), F.lit(0))
    newest = F.max_by(F.struct("period", size("lrb").alias("lrb_items"), size("zcfz").alias("zcfz_items"), size("llb").alias("llb_items")), P.period_ord(F.col("period")))
    return usable.groupBy("code").agg(newest.alias("n")).select("code", "n.*")


def catalog_entry(rows: DataFrame, dataset: str, category: str, scope: str, trading_day: str, cutoff: str, path: str) -> DataFrame:
    """One catalog row of a dataset: size, symbols, partition, place."""
    return rows.agg(
        F.count(F.lit(1)).alias("row_count"), F.countDistinct("market", "symbol").alias("symbol_count"),
    ).select(
        F.lit(dataset).alias("dataset_name"), F.lit(category).alias("dataset_category"), F.lit(scope).alias("dataset_scope"),
        F.lit("final").alias("data_status"), F.lit(f"trading_day={trading_day}").alias("partition"), F.lit(path).alias("path"),
        "row_count", "symbol_count", F.lit(cutoff).alias("data_cutoff_time"), F.lit("passed").alias("validation_status"))


def write_dataset(rows: DataFrame, path: str, **entry: str) -> DataFrame:
    """Write a dataset, then describe it from what was written."""
    rows.write.mode("overwrite").parquet(path)
    return catalog_entry(rows.sparkSession.read.parquet(path), path=path, **entry)


def write_current_and_archive(rows: DataFrame, current: str, archive: str, trading_day: str) -> None:
    """The current table and its copy in the day's archive partition, from one computation."""
    rows.write.mode("overwrite").parquet(current)
    copy = rows.sparkSession.read.parquet(current).withColumn("trading_day", F.lit(trading_day))
    copy.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("trading_day").parquet(archive)


def content_signature(spark: SparkSession, paths: list[str]) -> str:
    """A digest of what lies below ``paths``: every file's path, size and time of change, from listings alone."""
    import hashlib

    seen = []
    for name in paths:
        for root in spark._jvm.org.apache.hadoop.fs.Path(name).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(name)) or []:
            files = root.getPath().getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root.getPath(), True)
            while files.hasNext():
                file = files.next()
                seen.append((str(file.getPath()), file.getLen(), file.getModificationTime()))
    return hashlib.sha256(repr(sorted(seen)).encode()).hexdigest()


def cached_result(spark: SparkSession, root: str, key: dict[str, object], build, inputs: list[str] = ()) -> DataFrame:
    """Result table keyed by its parameters and the content of its ``inputs``: read it when it is there, else build and publish it.

    A result is written aside and renamed, so it is there whole or not at all; if another builder was first, its result stays and
    this one is dropped.
    """
    import uuid

    parts = {**key, "content": content_signature(spark, list(inputs))[:32]} if inputs else key
    path = root + "/" + "/".join(f"{k}={v}" for k, v in sorted(parts.items()))
    place = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = place(root).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place(f"{path}/_SUCCESS")):
        aside = f"{root}/_building/{uuid.uuid4().hex}"
        build().write.parquet(aside)
        fs.mkdirs(place(path).getParent())
        if fs.exists(place(path)) or not fs.rename(place(aside), place(path)):
            fs.delete(place(aside), True)
        else:
            late = place(f"{path}/{place(aside).getName()}")  # a rename into a folder that has just appeared
            if fs.exists(late):
                fs.delete(late, True)
    return spark.read.parquet(path)


RULES_SCHEMA = (
    "version string, default_decision string, default_bucket string, "
    "rules array<struct<id:string,priority:int,decision:string,bucket:string,match_type:string,patterns:array<string>,reason:string>>"
)


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Versioned rule configuration, one row per rule."""
    raw = spark.read.schema(RULES_SCHEMA).option("multiLine", True).json(path)
    return raw.select("version", "default_decision", "default_bucket", F.inline("rules"))


def rule_config_json(rules=spec.CONCEPT_RULES) -> Column:
    """The rule table of this package as configuration JSON."""
    entries = [
        F.struct(F.lit(i).alias("id"), F.lit(p).alias("priority"), F.lit(spec.HIDE).alias("decision"), F.lit(b).alias("bucket"), F.lit(m).alias("match_type"),
                 F.array(*[F.lit(x) for x in pats]).alias("patterns"))
        for i, p, b, m, pats in rules
    ]
    head = [F.lit(spec.CONCEPT_RULE_VERSION).alias("version"), F.lit(spec.CONCEPT_DEFAULT[2]).alias("default_decision"), F.lit(spec.CONCEPT_DEFAULT[1]).alias("default_bucket")]
    return F.to_json(F.struct(*head, F.array(*entries).alias("rules")))
