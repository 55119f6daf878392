"""Approximate nearest neighbours by balanced posting lists.

Centroids come from balanced halving of a bounded sample. Every distinct vector is posted to its nearest centroid's list and, when it
lies near a boundary, to the lists of the other centroids at almost the same distance. Centroids are found through a
neighbour graph held in memory: a beam walks it for a whole batch of vectors at once. A query reads the lists whose centroids are
within a ratio of the nearest one's distance.

A task holds a place: a run of lists, neighbours in the tree of halves, with a bounded number of vectors; longer lists are split. A vector is
stored once, where its nearest list is, and carries the numbers of all lists that hold it. A query goes once to each place that has a vector of
one of its lists, with a bit for each of these, so neither copies of vectors nor a row for each query and list are moved.

Inner products become distances by one more coordinate that gives all vectors the same length. Equal vectors are one: it
stands for its smallest ids, as many as a result can need, so a very common vector costs no more than another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from marketloom.llm.tables import discard, noted, settled, table

NEAREST = 20
LIST = 64  # vectors of a list, at least, while there are fewer than MOST_LISTS lists
MOST_LISTS = 4_096  # centroids in memory; beyond 262,144 vectors lists get longer and are read in shards
SAMPLE = 131_072  # vectors that the centroids are fitted on, the first by a hash, and at most SAMPLED for a list; all are indexed
SAMPLED = 32
LINKS, FAR_LINKS = 16, 4  # graph: nearest centroids, and others drawn at random
COPIES, COPY_RATIO = 4, 1.1  # lists of a boundary vector, and how much farther their centroids may be
PROBES, PROBE_SHARE, PROBE_RATIO, LEAST_PROBES = 96, 0.1875, 1.35, 24  # lists read at most (or this share of them), ratio of distances, and lists read at least
SHARD, COMPONENTS = 65_536, 1 << 22  # vectors of a place, and queries to it, that meet in a task, and components of either (32 MB as doubles)
LEAST_PLACE, SENT = 1_024, 0.6  # vectors of a place, at least; places only for the sake of more tasks, while queries at all of them are no more than this share of the vectors
MATRIX = 1 << 21  # numbers of a matrix at a time
SEED = 61


@dataclass(frozen=True)
class Index:
    centroids: object  # (k, d + 1)
    graph: object  # (k, links)
    entries: object  # where a walk starts
    longest: float  # largest norm of a vector


def lifted(vectors, longest: float):
    """Vectors of equal length: one more coordinate makes the nearest by distance the largest by inner product."""
    import numpy as np

    rest = np.sqrt(np.maximum(0.0, longest * longest - (vectors * vectors).sum(axis=1)))
    return np.hstack([vectors, rest[:, None]]) / longest


def lifted_queries(vectors):
    import numpy as np

    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.hstack([unit, np.zeros((len(unit), 1))])


def _halves(points, order, rng):
    """Two equal halves of ``points[order]`` by the difference of distances to two means."""
    import numpy as np

    own = points[order]
    ends = own[rng.choice(len(own), 2, replace=False)]
    for _ in range(8):
        parts = [own[low:low + 8_192] for low in range(0, len(own), 8_192)]
        lean = np.concatenate([((part - ends[0]) ** 2).sum(axis=1) - ((part - ends[1]) ** 2).sum(axis=1) for part in parts])
        ranked = np.argsort(lean, kind="stable")
        near, far = ranked[: len(own) // 2], ranked[len(own) // 2:]
        ends = np.array([own[near].mean(axis=0), own[far].mean(axis=0)])
    return order[near], order[far]


def list_count(vectors: int) -> int:
    """Lists of an index over so many vectors: the largest power of two that gives each LIST of them, up to MOST_LISTS."""
    count = 1
    while count * 2 <= MOST_LISTS and vectors // (count * 2) >= LIST:
        count *= 2
    return count


def build(sample, longest: float, lists: int) -> Index:
    """Centroids of balanced cells of the sample (original vectors), and their graph."""
    import numpy as np

    points, rng = lifted(sample, longest), np.random.default_rng(SEED)
    cells = [np.arange(len(points))]
    while len(cells) < lists and len(points) >= len(cells) * 4:
        cells = [half for cell in cells for half in _halves(points, cell, rng)]
    centroids = np.array([points[cell].mean(axis=0) for cell in cells])
    count = len(centroids)
    squares, near = (centroids ** 2).sum(axis=1), []
    for low in range(0, count, 256):
        apart = squares[low:low + 256, None] + squares[None, :] - 2 * centroids[low:low + 256] @ centroids.T
        near.append(np.argsort(apart, axis=1, kind="stable")[:, 1:LINKS + 1])
    graph = np.hstack([np.concatenate(near), rng.integers(0, count, (count, FAR_LINKS))])
    return Index(centroids, graph, rng.permutation(count)[: min(count, 32)], longest)


def nearest_lists(index: Index, points, most: int):
    """(list numbers, distances), nearest first, of up to ``most`` centroids of each point: a beam over the centroid graph."""
    import numpy as np

    centroids, squares = index.centroids, (index.centroids ** 2).sum(axis=1)
    width = min(max(most, 32), len(centroids))
    opens = max(8, width // 12)

    def best(ids, some, lengths, size, known):
        """The nearest different ids of each row. ``known`` keeps their distances, so each is computed once."""
        ids = np.sort(ids, axis=1)
        far = np.take_along_axis(known, ids, axis=1)
        far[:, 1:][ids[:, 1:] == ids[:, :-1]] = np.inf
        row, at = np.nonzero(np.isnan(far))
        new = ids[row, at]
        dots = np.einsum("nd,nd->n", centroids.take(new, axis=0), some.take(row, axis=0))
        known[row, new] = far[row, at] = np.maximum(0.0, squares[new] - 2 * dots + lengths[row])
        if far.shape[1] > size:
            part = np.sort(np.argpartition(far, size - 1, axis=1)[:, :size], axis=1)
            ids, far = np.take_along_axis(ids, part, axis=1), np.take_along_axis(far, part, axis=1)
        pick = np.argsort(far, axis=1, kind="stable")
        return np.take_along_axis(ids, pick, axis=1), np.take_along_axis(far, pick, axis=1)

    out_ids, out_far = [], []
    step = min(256, max(1, MATRIX // ((width + opens * index.graph.shape[1]) * centroids.shape[1])))
    for low in range(0, len(points), step):
        some = points[low:low + step]
        lengths, known = (some ** 2).sum(axis=1), np.full((len(some), len(centroids)), np.nan)
        beam, far = best(np.tile(index.entries, (len(some), 1)), some, lengths, min(width, len(index.entries)), known)
        seen = np.zeros((len(some), len(centroids)), dtype=bool)
        rows = np.arange(len(some))[:, None]
        while True:  # every round opens the nearest few of the beam that have not been
            fresh = np.where(seen[rows, beam], np.inf, far)
            pick = np.argsort(fresh, axis=1, kind="stable")[:, :opens]
            if np.isinf(np.take_along_axis(fresh, pick, axis=1)).all():
                break
            opened = np.take_along_axis(beam, pick, axis=1)
            seen[rows, opened] = True
            beam, far = best(np.hstack([beam, index.graph[opened].reshape(len(some), -1)]), some, lengths, width, known)
        far = np.where(np.isinf(far), np.inf, np.sqrt(far))
        out_ids += list(beam[:, :most])
        out_far += list(far[:, :most])
    return out_ids, out_far


def _within(ids, far, ratio: float, least: int):
    """The nearest lists within ``ratio`` of the nearest one's distance, ``least`` of them anyway."""
    import numpy as np

    some = np.isfinite(far) & ((far <= ratio * far[0] + 1e-12) | (np.arange(len(far)) < least))
    return ids[some]


def valid(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``vec_id, v, h1, h2``: rows that take part. ``h1, h2`` are a 128-bit hash of the vector; single precision is kept as it is.

    Out are rows with a null id, vectors that are null, empty, zero or hold a null or non-finite component, and, as they cannot be
    compared, vectors of another length than the most frequent one (of equally frequent ones the longer).
    """
    kind = vectors.schema[vector].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(vector).cast(f"array<{'float' if single else 'double'}>").alias("v"))
    rows = rows.where("vec_id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(finite & F.exists("v", lambda x: x != 0))
    length = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("v") == (length["d"] if length else 0))
    double = F.col("v").cast("array<double>")
    return rows.select("vec_id", "v", F.xxhash64(double).alias("h1"), F.xxhash64(F.reverse(double), F.lit(SEED)).alias("h2"))


def _matrix(column):
    """Vectors of an Arrow list column as rows of doubles."""
    import numpy as np

    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _lists(column):
    """(numbers, their rows) of an Arrow list column."""
    import numpy as np

    column = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy()))


def sampled(distinct: DataFrame, count: int, most: int):
    """The first ``most`` vectors by their hash. A bound on the hash leaves few more than these for the driver to sort."""
    import numpy as np

    share = (most + 8 * most ** 0.5 + 64) / count
    some = distinct.select("h1", "h2", "v")
    held = (some.where(F.col("h1") < int(share * 2 ** 64) - 2 ** 63) if share < 1 else some).toArrow()
    order = np.lexsort((held["h2"].to_numpy(), held["h1"].to_numpy()))[:most]
    return _matrix(held["v"].take(order))


def posted(vectors: DataFrame, index: Index, *, queries: bool) -> DataFrame:
    """``list, lists, rep, first, v``: the nearest list of each vector, and all that hold it or, for queries, that they read."""

    def post(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        most = max(PROBES, round(PROBE_SHARE * len(index.centroids))) if queries else COPIES
        ratio, least = (PROBE_RATIO, LEAST_PROBES) if queries else (COPY_RATIO, 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            raw = _matrix(batch.column("v"))
            points = lifted_queries(raw) if queries else lifted(raw, index.longest)
            lists = [_within(i, f, ratio, least) for i, f in zip(*nearest_lists(index, points, most))]
            ends = np.cumsum([0, *[len(x) for x in lists]])
            every = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(lists), pa.int32()))
            nearest = pa.array([int(x[0]) for x in lists], pa.int32())
            yield pa.RecordBatch.from_arrays([nearest, every, *[batch.column(c) for c in ("rep", "first", "v")]], names=["list", "lists", "rep", "first", "v"])

    columns = vectors.select("rep", F.element_at("ids", 1).alias("first"), "v")
    return columns.mapInArrow(post, f"list int, lists array<int>, rep bigint, first bigint, v {vectors.schema['v'].dataType.simpleString()}")


def place_runs(sizes: list[int], most: int) -> list[int]:
    """The place of each list: runs of lists that have up to ``most`` vectors together, or are one list."""
    places, held = [], 0
    for size in sizes:
        new = not places or held + size > most
        held = size if new else held + size
        places.append((places[-1] if places else -1) + new)
    return places


def sent(questions: DataFrame, cover, *, counted: bool = False) -> DataFrame:
    """``place, list, rep, bits, v``: each query at the places that have vectors of its lists (``cover``: lists by places), with a bit for each
    such list; ``counted``: ``place, n`` only."""

    def send(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        weight = cover.astype(np.float32)
        for batch in batches:
            if not batch.num_rows:
                continue
            reads = np.zeros((batch.num_rows, len(cover)), dtype=bool)
            number, row = _lists(batch.column("lists"))
            reads[row, number] = True
            goes = reads.astype(np.float32) @ weight > 0
            if counted:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(goes.shape[1]), pa.int32()), pa.array(goes.sum(axis=0), pa.int64())], names=["place", "n"])
                continue
            for place in np.flatnonzero(goes.any(axis=0)):
                row = np.flatnonzero(goes[:, place])
                bits = pa.array([x.tobytes() for x in np.packbits(reads[row] & cover[:, place], axis=1)], pa.binary())
                some = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), place), pa.int32()), some.column("list"), some.column("rep"), bits, some.column("v")],
                                                 names=["place", "list", "rep", "bits", "v"])

    if counted:
        return questions.select("lists").mapInArrow(send, "place int, n bigint")
    return questions.select("list", "lists", "rep", "v").mapInArrow(send, f"place int, list int, rep bigint, bits binary, v {questions.schema['v'].dataType.simpleString()}")


def _at_least(dots, most: int):
    """For each row a number that at least ``most`` of it reach (all, if there are fewer), and close to the largest such: from the largest of every 64."""
    import numpy as np

    whole = dots.shape[1] // 64
    if whole >= 2 * most:
        dots = dots[:, :whole * 64].reshape(len(dots), whole, 64).max(axis=2)
    least = min(most, dots.shape[1])
    return np.partition(dots, -least, axis=1)[:, -least]


def _within_reach(dots, least, reads, lists):
    """(rows, columns) of products from ``least`` of their row, of vectors in lists that the row's query reads."""
    import numpy as np

    row, col = np.nonzero(dots >= least[:, None])
    may = reads[row, lists[col, 0]]
    for k in range(1, lists.shape[1]):
        may |= reads[row, lists[col, k]]
    return row[may], col[may]


def _best_of(left, right):
    """Per query at a place, its nearest vectors there among those of its lists: ``query`` and arrays ``score, first, rep``. Whatever ties with the
    last place is scored exactly before the smallest ids are taken."""
    import numpy as np
    import pyarrow as pa

    most, out = NEAREST + 1, []
    if len(left) and len(right):
        order = np.lexsort((right["rep"].to_numpy(), right["first"].to_numpy()))
        reps, firsts, stack = right["rep"].to_numpy()[order], right["first"].to_numpy()[order], _matrix(right["v"])[order]
        number, row = _lists(right["lists"])
        held = np.bincount(row, minlength=len(right))
        starts = np.cumsum(held) - held
        member = np.stack([number[starts + np.minimum(k, held - 1)] for k in range(held.max())], axis=1)[order]
        lengths = np.linalg.norm(stack, axis=1).max()
        queries, bits, vectors = left["rep"].to_numpy(), left["bits"].combine_chunks(), left["v"].combine_chunks()
        queue = np.argsort(left["list"].to_numpy(), kind="stable")  # queries that read much the same
        for low in range(0, len(queue), 256):
            some = queue[low:low + 256]
            reads = np.unpackbits(np.frombuffer(b"".join(bits.take(pa.array(some)).to_pylist()), dtype=np.uint8).reshape(len(some), -1), axis=1).astype(bool)
            asked = _matrix(vectors.take(pa.array(some)))
            slack = 1e-12 * lengths * np.linalg.norm(asked, axis=1)  # more than products can differ by rounding
            at = np.flatnonzero(reads.any(axis=0)[member].any(axis=1))
            if not len(at):
                continue
            near, lists = (stack, member) if len(at) == len(stack) else (stack[at], member[at])
            step = max(1, MATRIX // len(at))
            widely = reads.sum() * lists.shape[1] > len(some) * reads.shape[1] // 2  # most of the vectors are read
            for top in range(0, len(some), step):
                block = slice(top, top + step)
                dots = asked[block] @ near.T
                row, col = np.zeros((2, 0), dtype=np.int64)
                if widely:
                    row, col = _within_reach(dots, _at_least(dots, 2 * most) - slack[block], reads[block], lists)
                few = np.flatnonzero(np.bincount(row, minlength=len(dots)) < most)  # what they do not read is out of the way first
                if len(few):
                    may = np.take(reads[block][few], lists[:, 0], axis=1)
                    for k in range(1, lists.shape[1]):
                        may |= np.take(reads[block][few], lists[:, k], axis=1)
                    less = np.where(may, dots[few], -np.inf)
                    back, at_ = np.nonzero((less >= (_at_least(less, most) - slack[block][few])[:, None]) & may)
                    rest = ~np.isin(row, few)
                    row, col = np.concatenate([row[rest], few[back]]), np.concatenate([col[rest], at_])
                    order_ = np.argsort(row, kind="stable")
                    row, col = row[order_], col[order_]
                cut = range(0, len(row), max(1, MATRIX // stack.shape[1]))
                pairs = [(near[col[c:c + cut.step]] * asked[block][row[c:c + cut.step]]).sum(axis=1) for c in cut]  # the same for a pair at whatever place
                score = np.concatenate([np.zeros(0), *pairs])
                pick = np.lexsort((col, -score, row))
                place = np.arange(len(row)) - np.searchsorted(row, row)  # row is sorted, and so is row[pick]
                pick = pick[place < most]
                out.append((queries[some[block]][row[pick]], score[pick], firsts[at[col[pick]]], reps[at[col[pick]]]))
    query, score, first, rep = [np.concatenate([x[i] for x in out]) for i in range(4)] if out else [np.zeros(0, dtype=t) for t in ("i8", "f8", "i8", "i8")]
    new = np.flatnonzero(np.diff(query, prepend=query[0] - 1)) if len(query) else np.zeros(0, dtype=np.int64)  # a query's rows are together
    ends = pa.array(np.append(new, len(query)), pa.int32())
    return pa.table({"query": query[new], **{c: pa.ListArray.from_arrays(ends, pa.array(x)) for c, x in (("score", score), ("first", first), ("rep", rep))}})


def neighbours(vectors: DataFrame, is_query, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: of each row for whose ``vec_id`` the condition holds, the nearest others found.

    Nearest first, ties to the smaller id; all others if there are fewer. Rows that ``valid`` leaves out are neither queries nor found. An
    id that repeats with one vector is one row; with several it is found under each. No rows give no rows.
    """
    spark = vectors.sparkSession
    with noted() as given:
        rows = settled(valid(vectors, key=key, vector=vector), "vectors")
    keys = rows.select("h1", "h2", "vec_id").distinct()
    by_vector = W.partitionBy("h1", "h2").orderBy("vec_id")
    few = keys.withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= NEAREST + 1)
    ids = few.groupBy("h1", "h2").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))  # at most NEAREST + 1
    one = rows.groupBy("h1", "h2").agg(F.min_by("v", "vec_id").alias("v"))
    with noted() as unique:
        distinct = settled(one.join(ids, ["h1", "h2"]).select(F.monotonically_increasing_id().alias("rep"), "h1", "h2", "v", "ids"), "distinct-vectors")
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest, count, d = distinct.agg(F.max(F.sqrt(squares)), F.count(F.lit(1)), F.max(F.size("v"))).first()
    if longest is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    asking = settled(keys.where(is_query(F.col("vec_id"))).join(distinct.select("h1", "h2", "rep"), ["h1", "h2"]).select(F.col("vec_id").alias("query_id"), "rep"), "queries")
    discard(spark, given)

    import numpy as np

    lists = list_count(count)
    index = build(sampled(distinct, count, min(SAMPLE, SAMPLED * max(lists, LIST))), float(longest), lists)
    names = settled(distinct.select("rep", "ids"), "ids-of-vectors")
    postings = settled(posted(distinct, index, queries=False), "postings")
    questions = settled(posted(distinct.join(asking.select("rep").distinct(), "rep", "left_semi"), index, queries=True), "questions")
    discard(spark, unique)

    # Tables of at most MOST_LISTS rows: lists with their places, places with their parts
    held = {r["list"]: r["n"] for r in postings.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = min(SHARD, max(1, COMPONENTS // d))
    wanted = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, int(SENT * count / max(1, questions.count()))))
    goal = min(most, max(LEAST_PLACE, -(-count // wanted)))
    runs = place_runs([held.get(i, 0) for i in range(len(index.centroids))], goal)
    places = F.broadcast(spark.createDataFrame(list(enumerate(runs)), "list int, place int"))
    pairs = postings.join(places, "list").select(F.explode("lists").alias("list"), "place").distinct()
    cover = np.zeros((len(runs), runs[-1] + 1), dtype=bool)
    for r in pairs.groupBy("list").agg(F.collect_list("place").alias("places")).collect():
        cover[r["list"], r["places"]] = True
    asks = dict(sent(questions, cover, counted=True).groupBy("place").agg(F.sum("n")).collect())
    size = np.bincount(runs, weights=[held.get(i, 0) for i in range(len(runs))]).astype(int)
    parts = [(p, -(-int(size[p]) // most), -(-asks.get(p, 0) // most)) for p in range(len(size))]
    parts = [x for x in parts if x[1] and x[2]]
    sizes = F.broadcast(spark.createDataFrame(parts, "place int, shards int, groups int"))
    met = sum(shards * groups for _, shards, groups in parts)
    tasks = min(4 * met, max(met, 512))  # parts are few and large: with more tasks than parts hardly two share one

    def spread(rows: DataFrame, own: str, other: str) -> DataFrame:
        """Each row in one part of its own side, and in all parts of the other."""
        every = F.explode(F.sequence(F.lit(0), F.col(f"{other}s") - 1)).alias(other)
        return rows.join(sizes, "place").select("*", F.pmod(F.xxhash64("rep"), f"{own}s").cast("int").alias(own), every).drop("shards", "groups")

    meet = ["place", "shard", "group"]
    asked = spread(sent(questions, cover), "group", "shard").repartition(tasks, *meet)
    stored = spread(postings.join(places, "list").drop("list"), "shard", "group").repartition(tasks, *meet)
    near = asked.groupBy(*meet).cogroup(stored.groupBy(*meet)).applyInArrow(
        _best_of, "query bigint, score array<double>, first array<bigint>, rep array<bigint>")

    # A vector's smallest id speaks for it: the first NEAREST + 1 vectors hold the first NEAREST + 1 ids.
    found = near.repartition("query").select("query", F.explode(F.arrays_zip("score", "first", "rep")).alias("c")).select("query", "c.*")
    order = W.partitionBy("query").orderBy(F.desc("score"), "first", "rep")
    found = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= NEAREST + 1).join(names, "rep")
    said = found.select("query", F.explode(F.transform("ids", lambda i: F.struct((-F.col("score")).alias("minus"), i.alias("vec_id")))).alias("c"))
    best = settled(said.groupBy("query").agg(F.slice(F.array_sort(F.collect_list("c")), 1, NEAREST + 1).alias("best")), "nearest-of-vectors")
    own = asking.join(best, asking["rep"] == best["query"]).select("query_id", F.slice(F.filter("best", lambda c: c["vec_id"] != F.col("query_id")), 1, NEAREST).alias("best"))
    return own.select("query_id", F.posexplode("best").alias("at", "c")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "c.vec_id", (-F.col("c.minus")).alias("score"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0)
