"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct word shingles (64-bit hashes). Two sets of similarity t or more share a shingle among the first
``n - ceil(t n) + 1`` of each in any common order; the order here puts shingles of one document first, which meet nobody and are not written,
then those of a few, and the most frequent ones last, so that common passages rarely meet. What takes part is thus the texts that share
most of their shingles, not what any two long texts happen to have in common. Equal sets are one set. Sets with equal size and prefix form one group; groups meet by the
shingles of their prefixes and are filtered by size, then pairs of groups are expanded to members, filtered by counts per hash
bin (a bound on the overlap) and verified on the whole sets.

A shingle under which many sets meet would give a square of pairs. There every set first meets one pivot, round after round while that
links at least half of them, so that masses of near copies take rows in proportion to their number. What then is already in
one component needs no further link. Under shingles where several components still meet, the largest is held against all others in
blocks: a task compares two blocks by products of their incidence matrices and returns a spanning forest of the links, at most one
row per set. Links become components by alternating stars, each a combinable minimum and a salted join.

Every distinct set has a number of its own, whatever ids its documents have, so repeated and null ids lose nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.tables import discard, filled, noted, settled, table
from marketloom.llm.texthash import chunks, lowered, mixed, runs, word_bounds

HEAVY_FROM = 32  # a shingle in more documents than this may be put last,
HEAVY_MOST = 1 << 16  # the most frequent ones only: 1.3 MB go to every task; any choice gives the same links
LEVELS = ((2, 28), (8, 26))  # shingles in so many documents or more come later, told by filters of at most 2 to this many bits (32 and 8 MB); a set bit too many costs time only
FILLED = 16  # a filter is halved while less than one bit in so many is set
RANGES = 8  # key ranges of the frequency count per shuffle partition, rounded down to a power of two in all
BINS = 256  # counts of a set's shingles by hash
FEW = 128  # sets that may meet pairwise under one shingle; more are compared in blocks
BLOCK = 256  # sets of a block
COLUMNS = 4096  # shingles of a matrix product at a time
BROADCAST_IDS = 500_000  # ids of 8 bytes; more are joined by a shuffle
SALTS = 8  # parts of a star's neighbours


@dataclass(frozen=True)
class Likeness:
    """Words of a shingle, and the similarity in percent from which two documents link."""

    words: int = 3
    percent: int = 90


CONTRACT = Likeness()
NEAR_COPIES = Likeness(words=5, percent=80)


def shingle_sets(texts: list[bytes], words: int):
    """Document numbers and shingle hashes, ordered by both, without repeats. A shorter text is one shingle; one without words none."""
    import numpy as np

    data, doc, starts, ends = word_bounds(texts)
    word = runs(lowered()[data], starts, ends)
    if not len(word):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    odd = np.uint64(0xD6E8FEB86659FD93)
    count = np.bincount(doc, minlength=len(texts))
    gram = word.copy()
    for k in range(1, words):
        gram[:-k] = mixed(gram[:-k] * odd + word[k:]) if k < len(word) else gram[:-k]
    place = np.arange(len(doc)) - (np.cumsum(count) - count)[doc]
    whole = place + words <= count[doc]
    out_doc, out = [doc[whole]], [gram[whole]]
    for d in np.flatnonzero((count > 0) & (count < words)):
        h = np.array([count[d]], dtype=np.uint64)
        for w in word[doc == d]:
            h = mixed(h * odd + w)
        out_doc.append(np.array([d]))
        out.append(h)
    doc, gram = np.concatenate(out_doc), np.concatenate(out)
    order = np.lexsort((gram, doc))
    doc, gram = doc[order], gram[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (gram[1:] != gram[:-1])
    return doc[new], gram[new]


def _each_set(texts: list[str], words: int) -> Iterator[tuple[int, object]]:
    """(number of the text, its sorted shingles)."""
    import numpy as np

    for first, chunk in chunks(texts):
        doc, gram = shingle_sets(chunk, words)
        bounds = np.searchsorted(doc, np.arange(len(chunk) + 1))
        for i in range(len(chunk)):
            yield first + i, gram[bounds[i]:bounds[i + 1]]


@dataclass(frozen=True)
class Frequencies:
    """``heavy``: the most frequent folded (32-bit) shingles and their counts over all documents; ``filters``: packed bits by the first bits
    of the folded shingle, one filter for each of LEVELS. A bit that is not set stands for shingles in fewer documents."""

    heavy: dict[int, int]
    filters: tuple

    def ranks(self, gram):
        """0 for a shingle that is in one document only, more for more frequent ones."""
        import numpy as np

        folded = gram >> np.uint64(32)
        rank = np.zeros(len(gram), dtype=np.int64)
        for level, bits in enumerate(self.filters):
            slot = (folded >> np.uint64(32 - (8 * len(bits)).bit_length() + 1)).astype(np.int64)
            rank += (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & (rank == level)
        if self.heavy:
            known = self._known()
            at = np.minimum(np.searchsorted(known[0], folded), len(known[0]) - 1)
            rank = np.where(known[0][at] == folded, len(self.filters) + known[1][at], rank)
        return rank

    def _known(self):
        import numpy as np

        if "_table" not in self.__dict__:
            shingles = np.array(sorted(self.heavy), dtype=np.uint64)
            object.__setattr__(self, "_table", (shingles, np.array([self.heavy[int(k)] for k in shingles], dtype=np.int64)))
        return self.__dict__["_table"]


def _halved(bits):
    """Packed bits, two neighbours as one."""
    import numpy as np

    byte = np.arange(256)
    pairs = sum((((byte >> (2 * k)) | (byte >> (2 * k + 1))) & 1) << k for k in range(4)).astype(np.uint8)
    return (pairs[bits[0::2]] << 4) | pairs[bits[1::2]]


def frequencies(docs: DataFrame, like: Likeness, text: str = "text") -> Frequencies:
    """How many documents have a shingle, as far as the common order needs it.

    A task sorts its folded shingles, cuts them into key ranges and ships the differences compressed, about two bytes for each
    shingle; a range is then counted in one task, which returns its part of the filters.
    """
    import zlib

    import numpy as np

    spark = docs.sparkSession
    ranges = 1 << ((RANGES * int(spark.conf.get("spark.sql.shuffle.partitions"))).bit_length() - 1)

    def fold(batches: Iterator) -> Iterator:
        import zlib

        import numpy as np
        import pandas as pd

        for batch in batches:
            held = [gram >> np.uint64(32) for _, chunk in chunks(batch["text"].tolist()) for gram in [shingle_sets(chunk, like.words)[1]]]
            folded = np.sort(np.concatenate(held or [np.zeros(0, dtype=np.uint64)]))
            cuts = np.searchsorted(folded, (np.arange(1, ranges, dtype=np.uint64) << np.uint64(32)) // np.uint64(ranges))
            parts = [(i, part) for i, part in enumerate(np.split(folded, cuts)) if len(part)]
            blobs = [zlib.compress(np.diff(part, prepend=np.uint64(0)).astype("<u4").tobytes(), 1) for _, part in parts]
            yield pd.DataFrame({"range": [i for i, _ in parts], "blob": blobs})

    def count(part):
        import zlib

        import numpy as np
        import pandas as pd

        runs_ = [np.cumsum(np.frombuffer(zlib.decompress(b), dtype="<u4").astype(np.int64)) for b in part["blob"]]
        shingle, df = np.unique(np.concatenate(runs_), return_counts=True)
        own, often, filters = int(part["range"].iloc[0]), df > HEAVY_FROM, []
        for least, size in LEVELS:
            bits = np.zeros((1 << size) // ranges, dtype=bool)
            bits[(shingle[df >= least] >> (32 - size)) - own * len(bits)] = True
            filters.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        return pd.DataFrame({"range": [own], "filters": [filters], "shingle": [shingle[often]], "df": [df[often]]})

    parts = docs.select(filled(text).alias("text")).mapInPandas(fold, "range bigint, blob binary")
    with noted() as paths:
        counted = settled(parts.groupBy("range").applyInPandas(count, "range bigint, filters array<binary>, shingle array<bigint>, df array<bigint>"), "shingle-counts")
    often = counted.select(F.explode(F.arrays_zip("shingle", "df")).alias("c")).select("c.shingle", "c.df")
    heavy = {r["shingle"]: r["df"] for r in often.orderBy(F.desc("df"), "shingle").limit(HEAVY_MOST).collect()}
    filters = []
    for level, (_, size) in enumerate(LEVELS):
        bits = np.zeros((1 << size) // 8, dtype=np.uint8).reshape(ranges, -1)
        got = counted.select("range", F.col("filters")[level].alias("bits")).toArrow()
        for own, blob in zip(got["range"].to_pylist(), got["bits"]):
            bits[own] = np.frombuffer(zlib.decompress(blob.as_buffer()), dtype=np.uint8)
        bits = bits.reshape(-1)
        while len(bits) > 8 and int(np.bitwise_count(bits).sum()) * FILLED < len(bits) * 8:
            bits = _halved(bits)
        filters.append(bits)
    discard(spark, paths)
    return Frequencies(heavy, tuple(filters))


def described(docs: DataFrame, often: Frequencies, like: Likeness, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, digest`` (of the set), ``prefix`` (its shingles that other documents may have), ``prefix_digest`` (of the whole prefix) and ``bins``
    (counts, 16-bit), one row per document. Where the prefix meets nobody, the last three are empty."""

    def describe(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rows = []
            for _, gram in _each_set(batch.column(1).to_pylist(), like.words):
                n = len(gram)
                rank = often.ranks(gram)
                length = n - -(-like.percent * n // 100) + 1 if n else 0
                first = np.lexsort((gram, rank))[:length] if rank.any() else np.arange(length)
                prefix = gram[first]
                meets = prefix[rank[first] > 0]
                if not len(meets):
                    rows.append((n, digest_of(gram), meets.view(np.int64), b"", b""))
                    continue
                bins = np.bincount((gram >> np.uint64(20)).astype(np.int64) & (BINS - 1), minlength=BINS)
                rows.append((n, digest_of(gram), meets.view(np.int64), digest_of(prefix), np.minimum(bins, 65535).astype("<u2").tobytes()))
            types = [pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 5, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n", "digest", "prefix", "prefix_digest", "bins"])

    read = docs.select(F.col(key).cast("bigint").alias("doc_id"), filled(text).alias("text"))
    return read.mapInArrow(describe, "doc_id bigint, n bigint, digest binary, prefix array<bigint>, prefix_digest binary, bins binary")


def digest_of(gram) -> bytes:
    from hashlib import blake2b

    return blake2b(gram.astype("<u8").tobytes(), digest_size=16).digest()


def _near(a: str, b: str, like: Likeness) -> Column:
    return (F.col(a) * 100 >= F.col(b) * like.percent) & (F.col(b) * 100 >= F.col(a) * like.percent)


def candidate_pairs(multi: DataFrame, members: DataFrame, like: Likeness) -> DataFrame:
    """Distinct pairs of sets ``a < b`` under shingles where few meet: pairs of groups by shingle and size, then their members, and the
    pairs inside small groups."""
    few = multi.where(F.col("met") <= FEW).select("shingle", "gid", "n")
    left, right = few, few.select("shingle", F.col("gid").alias("gid_b"), F.col("n").alias("n_b"))
    groups = left.join(right, "shingle").where((F.col("gid") < F.col("gid_b")) & _near("n", "n_b", like)).select("gid", "gid_b").distinct()
    one = members.select(F.col("gid"), F.col("rep").alias("a"))
    two = members.select(F.col("gid").alias("gid_b"), F.col("rep").alias("b"))
    across = groups.join(one, "gid").join(two, "gid_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    small = members.where(F.col("weight").between(2, FEW))
    inside = small.select("gid", F.col("rep").alias("a")).join(small.select("gid", F.col("rep").alias("b")), "gid").where("a < b").select("a", "b")
    return across.unionByName(inside)


def possible(pairs: DataFrame, bins: DataFrame, like: Likeness) -> DataFrame:
    """Pairs whose overlap can reach the similarity by the bound: sum over bins of the smaller count. A full bin (65,535) bounds nothing."""

    def bound(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            if not len(batch):
                continue
            x = np.frombuffer(b"".join(batch["bins_a"]), dtype="<u2").reshape(-1, BINS).astype(np.int64)
            y = np.frombuffer(b"".join(batch["bins_b"]), dtype="<u2").reshape(-1, BINS).astype(np.int64)
            most = np.minimum(x, y).sum(axis=1)
            total = (batch["n_a"] + batch["n_b"]).to_numpy()
            full = ((x == 65535) | (y == 65535)).any(axis=1)
            yield batch.loc[full | (100 * most >= like.percent * (total - most)), ["a", "b"]]

    one = bins.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("bins").alias("bins_a"))
    two = bins.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("bins").alias("bins_b"))
    return pairs.join(one, "a").join(two, "b").mapInPandas(bound, "a bigint, b bigint")


def set_table(docs: DataFrame, wanted: DataFrame, like: Likeness, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``rep, shingles`` (sorted, 64-bit) of the sets in ``wanted`` (``rep, digest, first``: the smallest id of a document with the set)."""

    def sets(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            grams = [gram for _, gram in _each_set(batch.column(0).to_pylist(), like.words)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest_of(g) for g in grams], pa.binary()), pa.array([g.astype("<u8").tobytes() for g in grams], pa.binary())], names=["digest", "shingles"])

    small = wanted.count() <= BROADCAST_IDS
    ids = wanted.where("first IS NOT NULL").select(F.col("first").alias("_first")).distinct()
    names = wanted.select("rep", "digest")
    read = docs.select(F.col(key).cast("bigint").alias("_id"), filled(text).alias("text"))
    known = read.join(F.broadcast(ids) if small else ids, F.col("_id") == F.col("_first"), "left_semi")
    if not wanted.where("first IS NULL").isEmpty():  # sets of documents without an id
        known = known.unionByName(read.where("_id IS NULL"))
    whole = known.select("text").mapInArrow(sets, "digest binary, shingles binary")
    return whole.join(F.broadcast(names) if small else names, "digest").select("rep", "shingles").dropDuplicates(["rep"])


def verified(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The pairs ``a, b`` that link."""

    def verify(batches: Iterator) -> Iterator:
        import numpy as np

        for batch in batches:
            keep = []
            for x, y in zip(batch["s_a"], batch["s_b"]):
                x, y = np.frombuffer(x, dtype="<u8"), np.frombuffer(y, dtype="<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= like.percent * (len(x) + len(y) - both))
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]

    joined = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("s_a")), "a")
    return joined.join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("s_b")), "b").mapInPandas(verify, "a bigint, b bigint")


def _forest(ids, sets, left: int, percent: int):
    """Rows (a, b) that connect what links among the sets: each of the first ``left`` with any, or all with all if ``left`` is 0."""
    import numpy as np

    size = np.array([len(s) for s in sets])
    token, at = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = np.bincount(at)[at] > 1
    _, at = np.unique(at[shared], return_inverse=True)
    row, width = row[shared], int(at.max()) + 1 if shared.any() else 0
    both = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    for low in range(0, width, COLUMNS):
        a, b = np.searchsorted(at, [low, low + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), dtype=np.float32)
        part[row[a:b], at[a:b] - low] = 1
        both += part @ part.T
    linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
    if left:
        linked[:left, :left] = linked[left:, left:] = False
    root = np.arange(len(sets))
    while True:  # smallest number reachable
        least = np.where(linked, root[None, :], len(sets)).min(axis=1)
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return [(int(ids[i]), int(ids[r])) for i, r in enumerate(root) if i != r]


def many_met(multi: DataFrame, members: DataFrame) -> DataFrame:
    """``key, rep, met``: the sets under shingles, and in groups, where more than FEW meet."""
    by_shingle = multi.where(F.col("met") > FEW).join(members.select("gid", "rep"), "gid").select(F.col("shingle").alias("key"), "rep", "met")
    by_group = members.where(F.col("weight") > FEW).select(F.xxhash64("gid").alias("key"), "rep", F.col("weight").alias("met"))
    return by_shingle.unionByName(by_group)


def star_links(many: DataFrame, sets: DataFrame, like: Likeness) -> list[DataFrame]:
    """Links ``a, b`` of sets with the pivot (the smallest number) under the most crowded of their keys; those without one get
    another pivot, as long as at least half find their link."""
    left = settled(many.groupBy("rep").agg(F.max(F.struct("met", "key")).alias("k")).select("rep", "k.key"), "crowded-sets")
    found: list[DataFrame] = []
    count = left.count()
    while count:
        pivots = left.groupBy("key").agg(F.min("rep").alias("pivot"))
        asked = left.join(pivots, "key").where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b"))
        found.append(settled(verified(asked, sets, like), "star-links"))
        alone = left.join(pivots.select(F.col("pivot").alias("rep")), "rep", "left_anti").join(found[-1].select(F.col("b").alias("rep")), "rep", "left_anti")
        left, before = settled(alone, "crowded-sets"), count
        count = left.count()
        if 2 * count > before:
            break
    return found


def block_links(many: DataFrame, together: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Connecting links ``a, b`` under keys where sets of several components meet: the largest component there with all other sets, and these
    with one another. ``together`` has ``node, component`` of sets that are linked already."""
    placed = many.join(together.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    placed = settled(placed, "crowded-components")
    sizes = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(
        F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("met"))
    open_ = sizes.where(F.col("met") > F.col("main.n")).select(
        "key", F.col("main.component").alias("main"), F.ceil(F.col("main.n") / BLOCK).alias("own"), F.ceil((F.col("met") - F.col("main.n")) / BLOCK).alias("others"))
    rows = placed.join(settled(open_, "open-keys"), "key")
    inside = F.col("component") == F.col("main")
    number = F.pmod(F.xxhash64("rep", "key"), F.when(inside, F.col("own")).otherwise(F.col("others")))
    rows = rows.select("key", "rep", inside.alias("inside"), number.alias("number"), "own", "others")
    # block numbers of the others are shifted behind those of the main component
    first = F.when(F.col("inside"), F.col("others")).otherwise(F.col("own") + F.col("others"))
    rows = rows.select("key", "rep", "inside", "number", "own", F.explode(F.sequence(F.lit(0).cast("bigint"), first - 1)).alias("other"))
    number = F.when(F.col("inside"), F.col("number")).otherwise(F.col("own") + F.col("number"))
    other = F.when(F.col("inside"), F.col("own") + F.col("other")).otherwise(F.col("other"))
    rows = rows.select("key", "rep", number.alias("number"), other.alias("other"))
    rows = rows.select("key", "rep", "number", F.least("number", "other").alias("i"), F.greatest("number", "other").alias("j"))

    def compare(part):
        import numpy as np
        import pandas as pd

        part = part.sort_values(["number", "rep"])
        same = part["i"].iloc[0] == part["j"].iloc[0]
        left = 0 if same else int((part["number"] == part["i"]).sum())
        if len(part) < 2 or left == len(part):
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        sets = [np.frombuffer(s, dtype="<u8") for s in part["shingles"]]
        return pd.DataFrame(_forest(part["rep"].to_numpy(), sets, left, like.percent), columns=["a", "b"], dtype="int64")

    return rows.join(sets, "rep").groupBy("key", "i", "j").applyInPandas(compare, "a bigint, b bigint")


def _with_least(rows: DataFrame, least: DataFrame, neighbour: str) -> DataFrame:
    """``rows`` with the ``m`` of their ``u``; a star's many neighbours are spread over SALTS parts."""
    salted = least.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(neighbour), F.lit(SALTS))).join(salted, ["u", "_salt"]).drop("_salt")


def components(links: DataFrame) -> DataFrame:
    """``node, component``: the smallest node reachable by ``a, b`` links, for all nodes that have one."""
    edges = settled(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with_least(both.where("v > u"), least, "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = settled(large, "large-star")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(edges, least, "v").select(F.col("v").alias("x"), "m").unionByName(least.select(F.col("u").alias("x"), "m"))
        edges = settled(small.where("x <> m").select(F.greatest("x", "m").alias("u"), F.least("x", "m").alias("v")).distinct(), "small-star")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = state


def _found(docs: DataFrame, like: Likeness, key: str, text: str) -> DataFrame:
    """``doc_id, n, digest, part, component_id``, one row per document; ``part`` numbers the component (null for an empty set)."""
    spark = docs.sparkSession
    with noted() as wide:
        described_docs = settled(described(docs, frequencies(docs, like, text), like, key=key, text=text), "shingle-prefixes")
    held = settled(described_docs.select("doc_id", "n", "digest"), "set-digests")
    with noted() as whole_unique:
        unique = described_docs.where("n > 0").groupBy("n", "digest").agg(
            F.min("doc_id").alias("first"), F.any_value(F.struct("prefix", "prefix_digest", "bins")).alias("s"))
        unique = settled(unique.withColumn("rep", F.monotonically_increasing_id()), "shingle-sets")
    discard(spark, wide)
    names = settled(unique.select("rep", "n", "digest", "first"), "set-names")
    meeting = unique.where(F.size("s.prefix") > 0)  # a prefix of which nothing is written is that of one document
    with noted() as grouping:
        grouped = settled(meeting.groupBy("n", "s.prefix_digest").agg(
            F.min("rep").alias("gid"), F.count(F.lit(1)).alias("weight"), F.min_by("s.prefix", "rep").alias("prefix")), "prefix-groups")
    own = meeting.select("rep", "n", F.col("s.prefix_digest").alias("prefix_digest"))
    members = settled(own.join(grouped.drop("prefix"), ["n", "prefix_digest"]).select("rep", "gid", "n", "weight"), "group-members")
    postings = grouped.select("gid", "n", "weight", F.explode("prefix").alias("shingle"))
    met = postings.groupBy("shingle").agg(F.sum("weight").alias("met"), F.count(F.lit(1)).alias("groups")).where("groups > 1")
    multi = settled(postings.select("gid", "n", "shingle").join(met.select("shingle", "met"), "shingle"), "met-shingles")
    discard(spark, grouping)

    maybe = settled(possible(candidate_pairs(multi, members, like), meeting.select("rep", "n", "s.bins"), like).distinct(), "possible-pairs")
    discard(spark, whole_unique)
    many = settled(many_met(multi, members), "crowded-keys")
    wanted = maybe.select(F.col("a").alias("rep")).union(maybe.select("b")).union(many.select("rep")).distinct()
    wanted = settled(wanted.join(names, "rep").select("rep", "digest", "first"), "wanted-sets")
    sets = settled(set_table(docs, wanted, like, key=key, text=text), "whole-sets")
    links = verified(maybe, sets, like)
    stars = star_links(many, sets, like)
    if stars:
        for more in stars:
            links = links.unionByName(more)
        links = settled(links, "verified-links")
        links = links.unionByName(block_links(many, settled(components(links), "linked-so-far"), sets, like))
    found = settled(components(links), "set-components")

    least = found.join(names.select(F.col("rep").alias("node"), "first"), "node").groupBy("component").agg(F.min("first").alias("least"))
    linked = found.join(settled(least, "least-ids"), "component").select(F.col("node").alias("rep"), F.col("component").alias("_part"), "least")
    by_set = names.join(linked, "rep", "left").select(
        "n", "digest", F.coalesce("_part", "rep").alias("part"), F.when(F.col("_part").isNull(), F.col("first")).otherwise(F.col("least")).alias("least"))
    by_set = settled(by_set, "components-of-sets")
    return held.join(by_set, ["n", "digest"], "left").select(
        "doc_id", "n", "digest", "part", F.when(F.col("part").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def linked_components(docs: DataFrame, like: Likeness = CONTRACT, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row per row of ``docs``.

    Null and empty texts, and texts of white space, have an empty set and are components of their own, named by their key. Every row is a document:
    rows that repeat a key with other texts are in the component of their own text. A row without a key links like any other; it has the smallest
    key of its component, or null if no row there has one. No rows give no rows. Only key and text are read, so other columns
    cannot clash.
    """
    return _found(docs, like, key, text).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def kept_rows(docs: DataFrame, like: Likeness = NEAR_COPIES, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, with all columns: that of the smallest key (rows without one come last), of equal keys that of the
    smallest digest, of rows with equal key and set any one. Documents with an empty set all stay, as does a text that shares no more than
    its key with one that goes."""
    found = settled(_found(docs, like, key, text), "near-copies")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    chosen = settled(found.where("n > 0").groupBy("part").agg(F.min(order).alias("c")).select("part", "c.doc_id", "c.digest"), "kept-sets")
    stays = chosen.select("part", F.col("doc_id").alias("_id"), F.col("digest").alias("_digest"))
    marked = found.join(stays, "part", "left").withColumn(
        "stay", F.col("part").isNull() | (F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))))
    keys = settled(marked.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("stay").alias("kept"), F.max("n").alias("largest")), "near-copy-keys")
    gone = keys.where("kept = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone"))
    drop = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    id_ = F.col(f"`{key}`").cast("bigint")
    # keys of which some rows stay and some go, or that repeat with a set, and rows without a key: told apart by their set
    torn = keys.where("kept > 0 AND rows > 1 AND largest > 0 OR doc_id IS NULL").select(F.col("doc_id").alias("_torn"))
    if torn.isEmpty():
        return docs.join(drop, id_ == F.col("_gone"), "left_anti")
    torn = settled(torn, "torn-keys")
    ids = torn.where("_torn IS NOT NULL")
    some = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    plain = docs.where(id_.isNotNull()).join(drop, id_ == F.col("_gone"), "left_anti").join(some, id_ == F.col("_torn"), "left_anti")
    others = docs.where(id_.isNotNull()).join(some, id_ == F.col("_torn"), "left_semi").unionByName(docs.where(id_.isNull()))

    def digests(texts):
        import pandas as pd

        return pd.Series([digest_of(gram) if len(gram) else None for _, gram in _each_set(texts.tolist(), like.words)])

    held = others.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), id_.alias("id"), filled(text).alias("text"))
    held = held.withColumn("digest", F.pandas_udf(digests, "binary")("text"))
    rows = held.join(chosen.select(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")), F.col("id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left_semi")
    one = rows.groupBy("id", "digest").agg(F.first("row").alias("row")).select("row.*")
    return plain.unionByName(one).unionByName(held.where("digest IS NULL").select("row.*"))


def op10_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + {CONTRACT.words - 1}], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {CONTRACT.words - 1}, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS held FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * held >= {CONTRACT.percent} * (x.n + y.n - held)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS d, doc_id AS r FROM documents UNION SELECT reach.d, ways.b FROM reach JOIN ways ON ways.a = reach.r)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r) AS component_id FROM documents JOIN reach ON d = doc_id LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""
