"""Statement warehouse: package cleaning, full build, incremental detection and upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.functions import periods as P
from marketloom.functions import text as T


def keep_first(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """First row per key. The planner keeps one candidate per key and map task before the shuffle."""
    w = W.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def clean_package(rows: DataFrame) -> DataFrame:
    """One statement package: base column titles (first of duplicates), canonical code, newest report per code."""
    base: dict[str, str] = {}
    for name in rows.columns:
        base.setdefault(name.rsplit(".", 1)[0], name)
    out = rows.select(*[F.col(f"`{name}`").alias(short) for short, name in base.items()])
    out = out.withColumn("code", T.canonical_code(F.col("code")))
    return keep_first(out, ["code"], newest_first(out))


def newest_first(rows: DataFrame) -> list[Column]:
    """Newest report first, then newest announcement, then a hash of the whole row, so that the pick is the same on every run."""
    announced = [F.col("announce_date").desc_nulls_last()] if "announce_date" in rows.columns else []
    return [F.col("report_date").desc_nulls_last(), *announced, F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])]


def with_period(rows: DataFrame) -> DataFrame:
    """Period label from the report date; rows without a report date leave."""
    known = rows.where(F.coalesce(F.col("report_date"), F.lit(0)) != 0)
    return known.withColumn("period", P.period_from_yyyymmdd(F.col("report_date")))


def newest_of_package(packages: DataFrame) -> DataFrame:
    """Each package holds one report per code, its newest; a full order makes the pick the same on every run."""
    return keep_first(packages, ["package", "code"], newest_first(packages))


def build(packages: DataFrame) -> DataFrame:
    """All periods of all packages: one row per code and period, newest announcement first."""
    rows = with_period(newest_of_package(packages))
    return keep_first(rows, ["code", "period"], [F.col("announce_date").desc(), F.col("report_date").desc(), F.col("package").desc()])


def meta(warehouse: DataFrame) -> DataFrame:
    """Per code: newest period and number of periods."""
    return warehouse.groupBy("code").agg(
        F.max_by("period", P.period_ord(F.col("period"))).alias("latest_period"), F.count(F.lit(1)).alias("period_count"))


def package_period(package: Column) -> Column:
    """Period named by the date at the end of a package's name."""
    return P.period_from_yyyymmdd(F.right(package, F.lit(8)).try_cast("int"))


def detect_updates(packages: DataFrame, known: DataFrame) -> DataFrame:
    """Records later than what each known code already has.

    A package is looked into for the codes whose newest period is older than the package, however many packages that are.
    """
    joined = newest_of_package(packages).join(known.select("code", "latest_period"), "code")
    older = P.period_ord(F.col("latest_period")) < P.period_ord(package_period(F.col("package")))
    rows = with_period(joined.where(older))
    fresh = rows.where(P.period_ord(F.col("period")) > P.period_ord(F.col("latest_period"))).drop("latest_period")
    return keep_first(fresh, ["code", "period"], [F.col("announce_date").desc(), F.col("report_date").desc(), F.col("package").desc()])


def upsert(existing: DataFrame, incoming: DataFrame, key: list[str], *, keep_announce: bool = False) -> DataFrame:
    """Incoming rows replace existing rows of the same key.

    ``keep_announce`` lets an unknown (0) announcement date inherit the stored one.
    """
    fresh = incoming
    if keep_announce:
        stored = existing.select(*key, F.col("announce_date").alias("_stored"))
        fresh = fresh.join(stored, key, "left").withColumn(
            "announce_date", F.coalesce(F.nullif("announce_date", F.lit(0)), F.col("_stored"), F.lit(0))).drop("_stored")
    return existing.join(incoming, key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def stale_codes(warehouse_meta: DataFrame, period: str) -> DataFrame:
    return warehouse_meta.where(F.col("latest_period") == period).select("code", "latest_period")


def available_periods(warehouse: DataFrame) -> DataFrame:
    return warehouse.select("period").distinct().orderBy(P.period_ord(F.col("period")).desc())


def write_periods(rows: DataFrame, path: str) -> None:
    """Write by period below ``path``: small periods one file, large ones several, of the advised size."""
    rows.hint("rebalance", "period").write.mode("errorifexists").partitionBy("period").parquet(path)


class VersionedPeriods:
    """A table of periods that changes from one whole version to the next.

    ``data/<version>/period=...`` holds what a change wrote; ``versions/<number>`` says in which folder each period is. A change writes new
    folders first and its version file last, under a name that can only be made once: a reader sees the old version or the new one
    whole, wherever a writer fails, and of two writers at once one gets an error. Periods that a change does not touch are neither
    read nor written.
    """

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())

    def _hadoop(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def version(self) -> int:
        """Number of the newest version, 0 if there is none."""
        folder = self._hadoop("versions")
        if not self._fs.exists(folder):
            return 0
        names = [status.getPath().getName() for status in self._fs.listStatus(folder)]
        return max((int(name) for name in names if name.isdigit()), default=0)

    def folders(self, version: int | None = None) -> dict[str, str]:
        """Period -> folder below ``data`` that holds it: one entry per reporting period."""
        import json

        number = self.version() if version is None else version
        if not number:
            return {}
        text = self.spark.read.option("wholetext", True).text(str(self._hadoop("versions", str(number)))).first()
        return json.loads(text["value"]) if text else {}

    def read(self, periods: list[str] | None = None, version: int | None = None) -> DataFrame:
        """The table, or some of its periods, as of the newest or a given version."""
        held = {p: f for p, f in self.folders(version).items() if periods is None or p in periods}
        if not held:
            raise LookupError(f"no such period in {self.path}")
        by_folder: dict[str, list[str]] = {}
        for p, folder in held.items():
            by_folder.setdefault(folder, []).append(p)
        out: DataFrame | None = None
        for folder, some in sorted(by_folder.items()):
            rows = self.spark.read.option("basePath", f"{self.path}/data/{folder}").parquet(*[f"{self.path}/data/{folder}/period={p}" for p in some])
            rows = rows.withColumn("period", F.col("period").cast("string"))
            out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
        return out

    def _publish(self, rows: DataFrame, keep: dict[str, str], base: int) -> int:
        import json
        import uuid

        folder = uuid.uuid4().hex
        write_periods(rows, f"{self.path}/data/{folder}")
        written = [s.getPath().getName().removeprefix("period=") for s in self._fs.listStatus(self._hadoop("data", folder)) if s.isDirectory()]
        text = json.dumps(keep | {p: folder for p in written}, sort_keys=True)
        file = self._fs.create(self._hadoop("versions", str(base + 1)), False)  # fails if it is there
        try:
            file.write(bytearray(text.encode()))
        finally:
            file.close()
        return base + 1

    def replace(self, rows: DataFrame) -> int:
        """A version that holds ``rows`` and nothing else."""
        return self._publish(rows, {}, self.version())

    def upsert(self, incoming: DataFrame, key: list[str], **options) -> int:
        """A version in which incoming rows replace those of the same key; only touched periods are read."""
        base = self.version()
        held = self.folders(base)
        touched = {r["period"] for r in incoming.select("period").distinct().collect()}  # reporting periods: four a year
        if not touched:
            return base
        known = sorted(touched & held.keys())
        merged = upsert(self.read(known, base), incoming, key, **options) if known else incoming
        return self._publish(merged, {p: f for p, f in held.items() if p not in touched}, base)

    def drop_old(self, keep: int = 2) -> None:
        """Remove folders that none of the newest ``keep`` versions names; readers of older versions must be done."""
        newest = self.version()
        used = {f for v in range(max(1, newest - keep + 1), newest + 1) for f in self.folders(v).values()}
        for status in self._fs.listStatus(self._hadoop("data")):
            if status.getPath().getName() not in used:
                self._fs.delete(status.getPath(), True)
