"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of documents. Block j (from 0) of a source with ``u`` of the period's ``L`` weight units is released at
slot floor(j L / u) and due at slot ceil((j + 1) L / u); in every slot the released block with the earliest deadline is taken.
All windows repeat after L slots, so one period is the whole schedule: slot of block j = slot of block j mod u in the period
+ L * (j div u). After any number of slots a source is less than one block away from its weight. When a source runs out,
the others go on with their weights scaled up, in a new phase.

The driver computes periods only: at most MAX_SOURCES sources of at least LEAST_UNITS units, about UNITS slots each, at most two
phases per source. All other sources have weights of their own too, but no table: their blocks meet those of the scheduled sources
on one clock. Block j of a source with weight w is due at (j + p) / w, where p is the source's fixed phase between 0 and 1; a
scheduled block is due when its sources together have gone through half of its slot at their weights. Blocks get their slots
in due order, so at any time of the clock every source is less than one block (a scheduled one less than two) from weight x clock.
A source that runs out no longer takes slots, which scales the others up.

Documents get their number within the source by DataFrame operations: a random order from a hash, cut into about
sqrt(n) buckets, counted, and numbered inside each bucket, so that a hot source is spread over many tasks.
"""

from __future__ import annotations

import heapq
import json
from bisect import bisect_left

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.llm.tables import settled, table

BLOCK = 16  # documents
UNITS = 1000  # weight units of all sources together, up to rounding
MAX_SOURCES = 100  # so many sources of the largest weights have slots in the period; all others are placed by due times
LEAST_UNITS = 10  # a source whose weight would be fewer units is placed by due times, which do not round
POOL = -1  # source number of those placed by due times
SEED = 29


def period_slots(units: list[int]) -> list[list[int]]:
    """Slots of every source's blocks in one period of sum(units) slots, earliest deadline first among released blocks."""
    length = sum(units)
    released: list[list[tuple[int, int]]] = [[] for _ in range(length)]
    for i, u in enumerate(units):
        for j in range(u):
            released[j * length // u].append((-(-(j + 1) * length // u), i))
    ready: list[tuple[int, int]] = []
    slots: list[list[int]] = [[] for _ in units]
    for slot in range(length):
        for block in released[slot]:
            heapq.heappush(ready, block)
        slots[heapq.heappop(ready)[1]].append(slot)
    return slots


def phases(blocks: dict[int, int], units: dict[int, int]) -> list[tuple[int, int, int, int, int, int, list[int]]]:
    """Rows (source, first block, end block, units, period, first slot, slots in the period) until all blocks are placed."""
    left, done, base, rows = dict(blocks), dict.fromkeys(blocks, 0), 0, []
    while alive := sorted(s for s, n in left.items() if n > 0):
        period = sum(units[s] for s in alive)
        slots = dict(zip(alive, period_slots([units[s] for s in alive])))
        length = min(left[s] * period // units[s] for s in alive)  # until the first source runs out
        rounds, rest = divmod(length, period)
        for s in alive:
            taken = rounds * units[s] + bisect_left(slots[s], rest)
            if taken:
                rows.append((s, done[s], done[s] + taken, units[s], period, base, slots[s]))
            left[s] -= taken
            done[s] += taken
        base += length
    return rows


def weight_units(counts: dict[int, int], weights: dict[int, float] | None = None) -> dict[int, int]:
    """Whole units in proportion to ``weights`` (default: the square root of a source's size), at least one each."""
    share = weights or {s: n ** 0.5 for s, n in counts.items()}
    total = sum(share[s] for s in counts)
    return {s: max(1, round(UNITS * share[s] / total)) for s in counts}


def mixed(docs: DataFrame, *, key: str = "doc_id", source: str = "source", carry: list[str], weights: dict[str | None, float] | None = None, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: ``row`` (struct of the columns in ``carry``), ``source_number``, ``block``, ``slot``, ``position``.

    ``position`` orders the mix: slot times the block size plus the place in the block; only a source's last, shorter block leaves
    a gap. Null is a source like any other. ``weights`` names targets by source (missing ones count as the smallest
    given; sources of weight 0 come last). Texts are not read. Rows that repeat are placed one by one; rows with a null key too.
    Within a source the order is a hash of the key and the row's place in its file, so that rows without a key, or of one key, are spread like
    others; rows that do not come straight from files are hashed with all they carry. No rows give no rows.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy(F.col(source).cast("string").alias("name")).count()
    sizes = settled(_weighted(sizes, weights).select("name", _own("name").alias("own"), "count", "weight"), "mix-sources")
    named = sizes.where("weight > 0").orderBy(F.desc("weight"), F.desc("count"), F.asc_nulls_first("name")).limit(MAX_SOURCES).collect()
    while named and UNITS * named[-1]["weight"] < LEAST_UNITS * sum(r["weight"] for r in named):
        named.pop()
    total = sizes.agg(F.count("*").alias("sources"), F.max("count").alias("largest")).first()
    numbers = {r["name"]: i for i, r in enumerate(named)}
    share = {i: r["weight"] for i, r in enumerate(named)}
    units = weight_units({i: r["count"] for i, r in enumerate(named)}, share)
    plan = phases({i: -(-r["count"] // block) for i, r in enumerate(named)}, units)

    pooled = total["sources"] > len(named)
    known = [x for name, i in numbers.items() if name is not None for x in (F.lit(name), F.lit(i))]
    by_name = F.create_map(*known)[F.col("name")] if known else F.lit(None).cast("int")
    number = F.when(F.col("name").isNull(), F.lit(numbers.get(None, POOL))).otherwise(F.coalesce(by_name, F.lit(POOL)))
    buckets = max(1, round((total["largest"] or 1) ** 0.5))
    columns = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(source).cast("string").alias("name")]
    try:  # rows of one key, or of none, are told apart by their place in the files, so that they are not one bucket
        rows = docs.select(*columns, F.xxhash64(F.col(key), F.lit(SEED), F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("h"))
    except AnalysisException:  # not straight from files: by all that they carry
        rows = docs.select(*columns, F.xxhash64(F.col(key), F.lit(SEED), *[F.col(f"`{c}`") for c in carry]).alias("h"))
    each = ["source_number", "own"] if pooled else ["source_number"]
    rows = rows.select(
        "row", number.alias("source_number"), *([_own("name").alias("own")] if pooled else []), "h", F.pmod(F.shiftrightunsigned("h", 7), F.lit(buckets)).alias("bucket"))
    held = settled(rows.groupBy(*each, "bucket").count(), "mix-buckets")
    before = W.partitionBy(*each).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # about sqrt(n) rows
    starts = held.select(*each, "bucket", "count", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    inside = W.partitionBy(*each, "bucket").orderBy("h")
    ranked = rows.withColumn("n", F.row_number().over(inside) - 1).join(starts.drop("count"), [*each, "bucket"])
    ranked = ranked.withColumn("index", F.col("start") + F.col("n")).withColumn("block", F.floor(F.col("index") / block))

    lookup = F.broadcast(_plan_table(spark, plan))  # bounded by MAX_SOURCES and UNITS, see above
    if pooled:
        found = ranked.join(_merged_slots(starts, sizes, lookup, sum(share.values()) / max(1, sum(units.values())), block), ["own", "block"])
        slot = F.col("slot")
    else:
        found, slot = _scheduled(ranked, lookup)
    placed = found.select("row", "source_number", "block", slot.alias("slot"), F.pmod(F.col("index"), F.lit(block)).alias("within"))
    return placed.select("row", "source_number", "block", "slot", (F.col("slot") * block + F.col("within")).alias("position"))


def _own(name: str) -> Column:
    """The source's name as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(name)), F.lit(""))


def _weighted(sizes: DataFrame, weights: dict[str | None, float] | None) -> DataFrame:
    if not weights:
        return sizes.withColumn("weight", F.sqrt("count"))
    said = F.from_json(F.lit(json.dumps([{"n": n, "w": float(w)} for n, w in weights.items()])), "array<struct<n: string, w: double>>")
    given = sizes.sparkSession.range(1).select(F.inline(said)).select(_own("n").alias("own"), "w")
    return sizes.withColumn("own", _own("name")).join(given, "own", "left").withColumn("weight", F.coalesce("w", F.lit(float(min(weights.values())))))


def _scheduled(blocks: DataFrame, lookup: DataFrame, how: str = "inner") -> tuple[DataFrame, Column]:
    """``blocks`` with their phase as ``now``, and their slot in the plan."""
    now = F.element_at(F.filter("phases", lambda p: (p["first"] <= F.col("block")) & (F.col("block") < p["end"])), 1)
    found = blocks.join(lookup, "source_number", how).withColumn("now", now)
    local = F.col("block") - F.col("now.first")
    slot = F.col("now.base") + F.floor(local / F.col("now.units")) * F.col("now.period") + F.element_at(
        "now.slots", (F.pmod(local, F.col("now.units")) + 1).cast("int"))
    return found, slot


def _merged_slots(starts: DataFrame, sizes: DataFrame, lookup: DataFrame, scale: float, block: int) -> DataFrame:
    """``own, block, slot`` of every block, scheduled or not, by due time; ``scale`` is the weight of one unit.

    A block belongs to the bucket that holds its first row, so that a hot source's blocks come from many rows.
    """
    spark = starts.sparkSession
    first, last = F.ceil(F.col("start") / block), F.floor((F.col("start") + F.col("count") - 1) / block)
    blocks = starts.where(first <= last).join(sizes.select("own", "weight"), "own")
    blocks = blocks.select("source_number", "own", "weight", F.explode(F.sequence(first, last)).alias("block"))
    found, slot = _scheduled(blocks, lookup, "left")
    start = F.pmod(F.xxhash64("own", F.lit(SEED)), F.lit(1 << 20)) + 0.5
    free = F.when(F.col("weight") > 0, (F.col("block") + start / (1 << 20)) / F.col("weight")).otherwise(F.lit(float("inf")))
    due = F.when(F.col("source_number") == POOL, free).otherwise(
        (F.col("now.turn") + (slot - F.col("now.base") + 0.5) / F.col("now.period")) / scale)
    order = ["due", "own", "block"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.select("own", "block", due.alias("due")).repartitionByRange(parts, *order)
    dealt = settled(dealt.withColumn("part", F.spark_partition_id()), "mix-due")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    offsets = dealt.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(W.partitionBy("part").orderBy(*order)) - 1
    return dealt.withColumn("place", place).join(F.broadcast(offsets), "part").select("own", "block", (F.col("offset") + F.col("place")).alias("slot"))


def _plan_table(spark: SparkSession, plan: list) -> DataFrame:
    """``source_number`` and its ``phases``, from literals; ``turn`` is the number of periods before a phase, each at its own length."""
    columns = "source_number, first, end, units, period, base, turn, slots"
    lengths = {base: period for *_, period, base, _ in plan}
    turns, turn = {}, 0.0
    for base, after in zip(sorted(lengths), [*sorted(lengths)[1:], None]):
        turns[base] = turn
        turn += (after - base) / lengths[base] if after else 0
    values = [f"({s}, {a}L, {b}L, {u}L, {p}L, {base}L, {turns[base]!r}D, '{','.join(map(str, slots))}')" for s, a, b, u, p, base, slots in plan]
    said = ", ".join(values) or "(0, 0L, 0L, 1L, 1L, 0L, 0D, '0')"
    rows = spark.sql(f"SELECT {columns} FROM VALUES {said} AS t({columns})").withColumn("slots", F.split("slots", ",").cast("array<bigint>"))
    return rows.groupBy("source_number").agg(F.collect_list(F.struct("first", "end", "units", "period", "base", "turn", "slots")).alias("phases"))


def mixed_rows(docs: DataFrame, *, key: str = "doc_id", source: str = "source", weights: dict[str | None, float] | None = None) -> DataFrame:
    """All documents with their columns, laid out in the order of the mix: written files follow it from first to last."""
    laid = mixed(docs, key=key, source=source, carry=docs.columns, weights=weights)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return laid.repartitionByRange(parts, "position").sortWithinPartitions("position").select("row.*")


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = mixed(table(spark, sf_dir, "documents"), carry=["doc_id", "source"])
    return laid.select("row.doc_id", "row.source", "block", "slot", "position")
