"""Vector code compression: product codes with memoised grid cells.

A vector of integers is cut into four equal parts; each part position has a codebook of 256 entries, and a part's code is its nearest
entry. Codebooks come from rounds of assignment and componentwise means, each one job: tasks return sums per entry, never vectors.

Assignment hashes each part's coarse cell, a box of a regular grid. An entry is dominated across a cell if, from everywhere in its
box, it is farther (smallest distance to the box) than some other entry can be (largest distance to the box). The entries not
dominated are worked out once per cell and kept; only they are evaluated exactly for the cell's parts. The grid is the finest one
on which a batch's parts share cells; where they share none, all entries are evaluated. Whatever the grid, the result is the same.

Distances are exact: in doubles while every number stays below 2**53, else in 64-bit or unbounded integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.tables import settled, table

PARTS, ENTRIES, ROUNDS = 4, 256, 4
SCALE = 1024
LARGEST = 1 << 53  # larger components count as this: beyond it doubles are no longer whole numbers apart
LONGEST = (1 << 63) - 1
SHARING = 8  # parts that must share a cell on average
LEVELS = 8  # grids tried, each twice as coarse as the one before
MEMO = 1 << 15  # cells kept by a task; beyond it the memo starts anew
BROADCAST_LABELS = 200_000


@dataclass
class Cells:
    """The memo of one codebook: candidates of the cells seen so far; ``asked`` and ``exact`` count entries, all and those evaluated."""

    book: object  # (entries, width)
    memo: dict = field(default_factory=dict)
    asked: int = 0
    exact: int = 0

    def __post_init__(self):
        import numpy as np

        self.plain = np.array(self.book, dtype=np.float64)
        some = self.plain[:64]
        apart = ((some[:, None] - some[None, :]) ** 2).sum(axis=2)
        near = np.sort(apart, axis=1)[:, 1] if len(some) > 1 else np.ones(1)
        self.side = max(1.0, float(np.sqrt(np.median(near) / self.plain.shape[1])) / 2)

    def candidates(self, side: float, cells):
        """For each cell, the numbers of the entries that are not dominated across it."""
        import numpy as np

        if len(self.memo) > MEMO:
            self.memo.clear()
        keys = [(side, cell.tobytes()) for cell in cells]
        new = [i for i, key in enumerate(keys) if key not in self.memo]
        for at in range(0, len(new), 64):
            some = new[at:at + 64]
            apart = np.abs((cells[some] + 0.5)[:, None, :] * side - self.plain[None, :, :])
            most = ((apart + side / 2) ** 2).sum(axis=2).min(axis=1)
            least = (np.maximum(0.0, apart - side / 2) ** 2).sum(axis=2)
            for i, ok in zip(some, least <= most[:, None] * (1 + 1e-9)):  # the margin covers rounding
                self.memo[keys[i]] = np.flatnonzero(ok)
        return [self.memo[key] for key in keys]

    def nearest(self, parts):
        """(entry number, exact squared distance) of each part; of equally near entries the first."""
        import numpy as np

        groups = self._shared(parts)
        found = np.empty(len(parts), dtype=np.int64)
        self.asked += len(parts) * len(self.plain)
        for rows, some in groups:
            self.exact += len(rows) * len(some)
            found[rows] = some[_closest(parts[rows], self.book[some])]
        gap = parts - self.book[found]
        return found, (gap * gap).sum(axis=1)

    def _shared(self, parts) -> list:
        """Pairs (rows, candidates) that cover the parts."""
        import numpy as np

        everything = [(np.arange(len(parts)), np.arange(len(self.plain)))]
        if parts.dtype == object or np.abs(parts).max(initial=0) > 1 << 40:
            return everything
        odd = np.random.default_rng(self.plain.shape[1]).integers(1 << 62, size=self.plain.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        for level in range(LEVELS):
            side = self.side * 2.0 ** level
            cells = np.floor(parts / side)
            hashed = (cells.astype(np.int64).astype(np.uint64) * odd).sum(axis=1, dtype=np.uint64)
            _, first, member = np.unique(hashed, return_index=True, return_inverse=True)
            if len(first) * SHARING > len(parts):
                continue
            if (cells[first][member] != cells).any():  # two cells with one hash
                continue
            order = np.argsort(member, kind="stable")
            rows = np.split(order, np.cumsum(np.bincount(member))[:-1])
            return list(zip(rows, self.candidates(side, cells[first])))
        return everything


def _closest(parts, entries):
    """Number of the nearest entry, exactly; ties to the first."""
    import numpy as np

    width = parts.shape[1]
    largest = max((int(abs(x)) for some in (parts, entries) for x in (some.max(), some.min())), default=0)
    if width * (2 * largest) ** 2 < 1 << 53:
        x, c = parts.astype(np.float64), entries.astype(np.float64)
        return ((c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)).argmin(axis=1)
    kind = np.int64 if width * (2 * largest) ** 2 < 1 << 62 else object
    x, c = parts.astype(kind), entries.astype(kind)
    out = []
    for part in x:
        gap = c - part
        out.append(int((gap * gap).sum(axis=1).argmin()))
    return np.array(out, dtype=np.int64)


def kept(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, label, x``: rows that take part, with floor(1024 * component) as long.

    Out are vectors that are null, empty or hold a null or non-finite component, and those of another length than the most frequent one that
    can be cut into four (of equally frequent ones the longer). Components beyond 2**53 after scaling count as 2**53.
    """
    rows = vectors.select(F.col(key).cast("bigint").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: F.coalesce((x == x) & (F.abs(x) < float("inf")), F.lit(False)))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & (F.size("v") % PARTS == 0) & finite)
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.lit(-float(LARGEST)), F.least(F.lit(float(LARGEST)), x * float(SCALE)))).cast("bigint"))
    rows = settled(rows.select("vec_id", "label", whole.alias("x")), "code-vectors")
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(2).collect()
    return rows.where(F.size("x") == lengths[0]["d"]) if len(lengths) > 1 else rows


def _split(column) -> list:
    """The parts of a batch's vectors, one matrix per position."""
    import numpy as np

    flat = column.flatten().to_numpy(zero_copy_only=False)
    whole = flat.reshape(len(column), -1)
    if np.abs(whole).max(initial=0) > 1 << 28:
        whole = whole.astype(object)
    return np.split(whole, PARTS, axis=1)


def first_books(rows: DataFrame) -> list:
    """Codebooks of the vectors with the smallest ids: at most ENTRIES rows come to the driver. Rows without an id come last."""
    import numpy as np

    drawn = rows.orderBy(F.asc_nulls_last("vec_id"), "x").select("x").limit(ENTRIES).collect()
    if not drawn:
        return []
    return [np.array(book) for book in np.split(np.array([r["x"] for r in drawn], dtype=object), PARTS, axis=1)]


def _ready(book):
    """Entries as 64-bit integers where they are small enough to be squared and summed, else unbounded."""
    import numpy as np

    return book.astype(np.int64) if max(abs(int(book.max())), abs(int(book.min()))) <= 1 << 28 else book


def refined(rows: DataFrame, books: list) -> list:
    """One round: the mean of the parts of every entry, componentwise, rounded down; an entry without parts stays.

    Tasks return at most PARTS * ENTRIES sums of each component; so many numbers come to the driver.
    """

    def sums(batches: Iterator) -> Iterator:
        from decimal import Decimal

        import numpy as np
        import pyarrow as pa

        memos = [Cells(_ready(book)) for book in books]
        total = [np.zeros(book.shape, dtype=object) for book in books]
        count = [np.zeros(len(book), dtype=np.int64) for book in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, part in enumerate(_split(batch.column(0))):
                found, _ = memos[p].nearest(part)
                order = np.argsort(found, kind="stable")
                entry, low = np.unique(found[order], return_index=True)
                total[p][entry] += np.add.reduceat(part[order], low, axis=0).astype(object)
                count[p] += np.bincount(found, minlength=len(books[p]))
        said = [(p, int(e), j, Decimal(int(total[p][e, j])), int(count[p][e])) for p in range(PARTS) for e in np.flatnonzero(count[p]) for j in range(total[p].shape[1])]
        columns = list(zip(*said)) or [(), (), (), (), ()]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.decimal128(38, 0), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["part", "entry", "at", "total", "n"])

    partial = rows.select("x").mapInArrow(sums, "part int, entry int, at int, total decimal(38,0), n bigint")
    moved = [book.copy() for book in books]
    for r in partial.groupBy("part", "entry", "at").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect():
        moved[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return moved


def assigned(rows: DataFrame, books: list) -> DataFrame:
    """``vec_id, label, code, error``: entry numbers in hex and the squared distances summed (at most the largest long)."""

    def assign(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        memos = [Cells(_ready(book)) for book in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, error = [], np.zeros(batch.num_rows, dtype=object)
            for memo, part in zip(memos, _split(batch.column(2))):
                found, far = memo.nearest(part)
                codes.append(found)
                error += far.astype(object)
            said = [bytes(row).hex() for row in np.array(codes, dtype=np.uint8).T]
            error = [min(int(e), LONGEST) for e in error]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(said, pa.string()), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    kind = rows.schema["label"].dataType.simpleString()
    return rows.select("vec_id", "label", "x").mapInArrow(assign, f"vec_id bigint, label {kind}, code string, error bigint")


def books_text(books: list) -> str:
    return ",".join(str(int(x)) for book in books for entry in book for x in entry)


def coded(vectors: DataFrame, *, rounds: int = ROUNDS, **columns) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256``, one row per vector that takes part (see ``kept``).

    ``label_error`` is the error summed over equal labels, nulls together, at most the largest long. Repeated rows are coded each; of equal ids the
    smaller vector comes first in the codebook. With fewer than 256 vectors codebooks are as short. No vectors give no rows.
    """
    import hashlib

    rows = kept(vectors, **columns)
    books = first_books(rows)
    for _ in range(rounds if books else 0):
        books = refined(rows, books)
    digest = hashlib.sha256(books_text(books).encode()).hexdigest()
    found = settled(assigned(rows, books), "vector-codes")
    sums = found.groupBy(F.col("label").alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    sums = settled(sums.select("_label", F.least("total", F.lit(LONGEST).cast("decimal(38,0)")).cast("bigint").alias("label_error")), "label-errors")
    if sums.count() <= BROADCAST_LABELS:
        sums = F.broadcast(sums)
    return found.join(sums, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def decoded(codes: DataFrame, books: list) -> DataFrame:
    """``vec_id, v``: the vectors that the codes stand for."""
    entries = F.from_json(F.lit(str([[[int(x) / SCALE for x in entry] for entry in book] for book in books])), "array<array<array<double>>>")
    number = [F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int") for p in range(PARTS)]
    return codes.withColumn("_books", entries).select("vec_id", F.concat(*[F.col("_books")[p][number[p]] for p in range(PARTS)]).alias("v"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coded(table(spark, sf_dir, "embeddings"))


def _sql() -> str:
    steps = [f"""kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rn, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v
      FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"parts AS (SELECT rn, p, v[p * (len(v) // {PARTS}) + 1 : (p + 1) * (len(v) // {PARTS})] AS x FROM kept, range({PARTS}) AS r(p))",
             f"c0 AS (SELECT p, rn - 1 AS e, x FROM parts WHERE rn <= {ENTRIES})"]
    assign = """a{r} AS (SELECT rn, p, min(d * 256 + e) AS best FROM (SELECT q.rn, q.p, c.e, list_dot_product(q.x, q.x) - 2 * list_dot_product(q.x, c.x)
      + list_dot_product(c.x, c.x) AS d FROM parts q JOIN c{r} c ON q.p = c.p) GROUP BY rn, p)"""
    for r in range(ROUNDS):
        steps.append(assign.format(r=r))
        steps.append(f"""m{r} AS (SELECT p, e, list(x ORDER BY j) AS x FROM (SELECT a.p, CAST(a.best AS BIGINT) % 256 AS e, j, floor(sum(q.x[j]) / count(*)) AS x
      FROM a{r} a JOIN parts q ON a.rn = q.rn AND a.p = q.p, LATERAL (SELECT unnest(range(1, len(q.x) + 1)) AS j) GROUP BY 1, 2, 3) GROUP BY p, e)""")
        steps.append(f"c{r + 1} AS (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN m{r} m ON c.p = m.p AND c.e = m.e)")
    steps.append(assign.format(r=ROUNDS))
    steps.append(f"books AS (SELECT sha256(string_agg(said, ',' ORDER BY p, e)) AS codebooks_sha256 FROM "
                 f"(SELECT p, e, array_to_string(list_transform(x, lambda y: CAST(CAST(y AS BIGINT) AS VARCHAR)), ',') AS said FROM c{ROUNDS}))")
    steps.append(f"""codes AS (SELECT rn, string_agg(printf('%02x', CAST(best AS BIGINT) % 256), '' ORDER BY p) AS code,
      CAST(sum(CAST(best AS BIGINT) // 256) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rn)""")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN codes USING (rn), books"""


OP12_SQL = _sql()
