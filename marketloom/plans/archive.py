"""Daily archive: datasets, checks, manifest and run record. Catalog and audit tables hold a few rows per day."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom import spec
from marketloom.sources import files


@dataclass(frozen=True)
class ArchiveContext:
    trading_day: str
    root: str
    force_rerun: bool = False
    rerun_reason: str | None = None
    versions: tuple[str, str, str] = ("1.0.0", "1.0.0", "1.0.0")
    data_status: str = "final"

    @property
    def cutoff(self) -> str:
        return f"{self.trading_day} 15:00:00"


def validations(catalog: DataFrame, *, trading_day: str, cutoff: str, data_status: str = "final", versions: tuple[str, ...] = ("1", "1", "1"), audit_present: bool) -> DataFrame:
    """Nine checks over the catalog, one row each. All dataset checks come from one aggregate."""
    required = F.array(*[F.lit(n) for n in sorted(spec.REQUIRED_DATASETS)])
    facts = catalog.agg(
        F.array_sort(F.array_except(required, F.collect_set("dataset_name"))).alias("missing"),
        F.count_if(F.col("partition") != f"trading_day={trading_day}").alias("bad_partition"),
        F.count_if(F.coalesce(F.col("row_count") < 0, F.lit(True))).alias("bad_count"),
        F.count_if(F.col("data_cutoff_time") != cutoff).alias("bad_cutoff"),
        F.count_if(~F.col("artifact_exists")).alias("lost_artifact"),
        F.count_if(F.col("dataset_category") == "snapshot").alias("snapshots"),
    )
    checks: list[tuple[str, Column]] = [
        ("final_data_status_check", F.lit(data_status == "final")),
        ("dataset_presence_check", F.size("missing") == 0),
        ("version_presence_check", F.lit(all(versions))),
        ("archive_partition_check", F.col("bad_partition") == 0),
        ("row_count_sanity_check", F.col("bad_count") == 0),
        ("timestamp_consistency_check", F.col("bad_cutoff") == 0),
        ("artifact_existence_check", F.col("lost_artifact") == 0),
        ("snapshot_presence_check", F.col("snapshots") > 0),
        ("audit_log_presence_check", F.lit(audit_present)),
    ]
    detail = F.concat(F.lit("missing datasets: "), F.array_join("missing", ", "))
    rows = [
        F.struct(
            F.lit(name).alias("check_name"), F.when(ok, "passed").otherwise("failed").alias("status"),
            (F.when(~ok, detail) if name == "dataset_presence_check" else F.lit(None).cast("string")).alias("details"))
        for name, ok in checks
    ]
    return facts.select(F.inline(F.array(*rows)))


def validation_summary(checks: DataFrame) -> DataFrame:
    return checks.agg(
        F.count(F.lit(1)).alias("checks_total"), F.count_if(F.col("status") == "passed").alias("checks_passed"),
        F.count_if(F.col("status") == "failed").alias("checks_failed"),
    ).withColumn("overall_status", F.when(F.col("checks_failed") == 0, "passed").otherwise("failed"))


def next_manifest(previous: DataFrame, catalog: DataFrame, checks: DataFrame, trading_day: str, reason: str | None = None) -> DataFrame:
    """Manifest row of the next revision: run id, rerun chain, snapshot and validation summary."""
    last = previous.where(F.col("trading_day") == trading_day).agg(F.coalesce(F.max("archive_revision"), F.lit(0))).scalar()
    facts = catalog.agg(
        F.count(F.lit(1)).alias("dataset_count"),
        *[F.max((F.col("dataset_category") == "snapshot") & (F.col("dataset_scope") == s)).alias(s) for s in ("market", "stock")])
    revision = (last + 1).cast("bigint")
    c = F.col
    status = lambda flag: F.when(F.coalesce(flag, F.lit(False)), "available").otherwise("not_enabled")
    overall = validation_summary(checks).select("overall_status").scalar()
    return facts.select(
        F.lit(trading_day).alias("trading_day"), revision.alias("archive_revision"), "dataset_count", status(c("market")).alias("market_snapshot"),
        status(c("stock")).alias("stock_snapshot"), overall.alias("validation_status"),
    ).select(
        "*", F.concat(F.lit(f"archive_{trading_day.replace('-', '')}_"), F.lpad(c("archive_revision").cast("string"), 2, "0")).alias("run_id"),
        (c("archive_revision") > 1).alias("is_rerun"), F.when(c("archive_revision") > 1, c("archive_revision") - 1).alias("rerun_of"),
        F.lit(reason).cast("string").alias("rerun_reason"))


def rerun_allowed(runs: DataFrame, trading_day: str, force: bool) -> bool:
    """A day that already succeeded runs again only by force."""
    done = runs.where((F.col("trading_day") == trading_day) & (F.col("archive_status") == "success"))
    return force or done.isEmpty()


RUNS_SCHEMA = "trading_day string, archive_revision bigint, run_id string, archive_status string, dataset_count bigint, validation_passed boolean, failed_stage string, error string"


def run_record(manifest: DataFrame, status: str = "success") -> DataFrame:
    return manifest.select(
        "trading_day", "archive_revision", "run_id", F.lit(status).alias("archive_status"), "dataset_count",
        (F.col("validation_status") == "passed").alias("validation_passed"), F.lit(None).cast("string").alias("failed_stage"), F.lit(None).cast("string").alias("error"))


def artifact_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done))


def runs_table(spark: SparkSession, root: str) -> DataFrame:
    """All run records so far; empty before the first run."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/archive_runs")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(RUNS_SCHEMA).parquet(f"{root}/archive_runs")
    return spark.createDataFrame([], RUNS_SCHEMA)


def run(spark: SparkSession, ctx: ArchiveContext, datasets: list[tuple[str, str, str, DataFrame]]) -> DataFrame:
    """Write every dataset of the day, check the catalog, append manifest and run record; returns the run record.

    ``datasets`` are (name, category, scope, rows). A failure is recorded as a failed run before it is raised again.
    """
    runs = runs_table(spark, ctx.root)
    if not rerun_allowed(runs, ctx.trading_day, ctx.force_rerun):
        raise RuntimeError(f"{ctx.trading_day} is already archived; force a rerun to create another revision")
    day = f"{ctx.root}/trading_day={ctx.trading_day}"
    stage = "datasets"
    try:
        entries: DataFrame | None = None
        for name, category, scope, rows in datasets:
            stage = f"dataset {name}"
            path = f"{day}/{category}/{name}"
            entry = files.write_dataset(rows, path, dataset=name, category=category, scope=scope, trading_day=ctx.trading_day, cutoff=ctx.cutoff)
            entry = entry.withColumn("artifact_exists", F.lit(artifact_exists(spark, path)))
            entries = entry if entries is None else entries.unionByName(entry)
        stage = "catalog"
        entries.coalesce(1).write.mode("overwrite").parquet(f"{day}/catalog")
        catalog = spark.read.parquet(f"{day}/catalog")
        stage = "audit"
        audit = catalog.select("dataset_name", "path", "row_count", F.lit("written").alias("event"), F.current_timestamp().alias("at"))
        audit.coalesce(1).write.mode("overwrite").parquet(f"{day}/audit")
        stage = "checks"
        checks = validations(
            catalog, trading_day=ctx.trading_day, cutoff=ctx.cutoff, data_status=ctx.data_status, versions=ctx.versions, audit_present=artifact_exists(spark, f"{day}/audit"))
        stage = "manifest"
        record = run_record(next_manifest(runs, catalog, checks, ctx.trading_day, ctx.rerun_reason))
        record.coalesce(1).write.mode("append").parquet(f"{ctx.root}/archive_runs")
    except Exception as error:
        last = runs.where(F.col("trading_day") == ctx.trading_day).agg(F.max("archive_revision")).first()[0] or 0
        run_id = f"archive_{ctx.trading_day.replace('-', '')}_{last + 1:02d}"
        failed = spark.createDataFrame([(ctx.trading_day, last + 1, run_id, "failed", 0, False, stage, str(error)[:1000])], RUNS_SCHEMA)
        failed.write.mode("append").parquet(f"{ctx.root}/archive_runs")
        raise
    return runs_table(spark, ctx.root)


def update_status(snapshots: DataFrame, valuation: DataFrame, newest: dict[str, Column] | None = None) -> DataFrame:
    """One row: newest statement period and announcement, valuation completeness counts, and the newest time of each source in ``newest``."""
    report = snapshots.agg(F.max_by("period", "period_ord").alias("period"), F.max("announce_date").cast("bigint").alias("announced"))
    counts = valuation.agg(
        F.count(F.lit(1)).alias("industry_count"), F.sum("member_valuation_row_count").alias("member_valuation_row_count"),
        F.count_if("is_complete").alias("complete_industry_count"))
    return counts.withColumns({
        "latest_period": report.select("period").scalar(), "financial_updated": report.select("announced").scalar(), **(newest or {})})
