"""Phrase collocations by Rabin-Karp fingerprints.

A task hashes its texts with prefix polynomials in numpy: first the bytes of every word, then runs of word hashes, so that the
fingerprint of any n-gram is one difference of prefix sums. Fingerprints (of the words and their language) are counted by a shuffle
that combines map-side, one length after another: an n-gram is only counted where both of its (n-1)-grams are frequent, as no
other can be. The frequent ones of a length are known to tasks as a filter of a fixed number of bits; a filter may let an
n-gram through that is not needed, and loses none.

A last pass takes what the filters let through, verifies it and materialises it: in a task each fingerprint points to one
occurrence, all others are compared with the text there (bytes word by word, then words), and fingerprints that stand for more than one phrase are told apart. Then text
and count go through the shuffle, so counts are those of phrases, not of fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.llm.tables import filled, settled, table
from marketloom.llm.texthash import lowered, mixed, runs

WORDS = 5  # of the longest phrase
LEAST = 100  # occurrences of a candidate
BEST = 2000  # phrases of a language
CHUNK = 1 << 20  # bytes hashed at a time; longer texts are cut between words
FILTER_BITS = 1 << 27  # of a length's filter: 16 MB go to every task, whatever the corpus
BLOCK_BITS = 1 << 16  # of a filter, built by one group
SALTS = 64  # groups of a language in the first round of ranking
BROADCAST_LANGS = 100_000  # more languages are joined by a shuffle
NO_LANG = "und"


@dataclass
class Grams:
    """The words of a chunk: their bytes, piece, text and hash. Only words before ``own`` of their text start n-grams of this chunk."""

    data: object
    starts: object
    ends: object
    piece: object
    seed: object  # hash of the language, by word
    word: object
    own: object  # whether the word belongs to this chunk, and not to what follows it

    def hashes(self, n: int):
        """Fingerprints of the n-grams from each word on, and which of them exist."""
        import numpy as np

        count = len(self.word)
        if count < n:
            return np.zeros(count, dtype=np.uint64), np.zeros(count, dtype=bool)
        at = np.arange(count - n + 1)
        gram = np.zeros(count, dtype=np.uint64)
        gram[: count - n + 1] = mixed(runs(self.word, at, at + n) + self.seed[: count - n + 1] * np.uint64(2 * n + 1))
        whole = np.zeros(count, dtype=bool)
        whole[: count - n + 1] = self.piece[: count - n + 1] == self.piece[n - 1:]
        return gram, whole


def cut_texts(texts: list[str], langs: list[str], most: int = CHUNK) -> Iterator[tuple[list[bytes], list[str], list[int]]]:
    """Chunks of (bytes, language, how many of the bytes start n-grams here). A long text is cut before a word; each part is followed by
    the WORDS - 1 words after it."""
    import re

    gap = re.compile(rb"[\x20\x09\x0a-\x0d.,;:!?]")
    ahead = re.compile(rb"(?:[\x20\x09\x0a-\x0d.,;:!?]*[^\x20\x09\x0a-\x0d.,;:!?]+){%d}" % (WORDS - 1))
    held: tuple[list[bytes], list[str], list[int]] = ([], [], [])
    size = 0
    for text, lang in zip(texts, langs):
        blob = text.encode("utf-8", "surrogatepass")
        low = 0
        while low < len(blob):
            found = gap.search(blob, low + most) if len(blob) - low > most else None
            high = found.start() if found else len(blob)
            more = ahead.match(blob, high) if found else None
            stop = more.end() if more else len(blob)
            if size and size + stop - low > most:
                yield held
                held, size = ([], [], []), 0
            for column, value in zip(held, (blob[low:stop], lang, high - low)):
                column.append(value)
            size += stop - low
            low = high
    if size:
        yield held


def grams(blobs: list[bytes], langs: list[str], own: list[int]) -> Grams:
    import zlib

    import numpy as np

    kind = np.zeros(256, dtype=np.uint8)
    kind[[32, 9]] = 1
    kind[[10, 11, 12, 13, *b".,;:!?"]] = 2
    data = np.frombuffer(b"\n".join([b"", *blobs, b""]), dtype=np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    of = kind[data]
    edge = np.flatnonzero((of[1:] > 0) != (of[:-1] > 0)) + 1
    starts, ends = edge[0::2], edge[1::2]
    begins = np.cumsum([1, *[len(b) + 1 for b in blobs]])
    text = np.searchsorted(begins, starts, side="right") - 1
    seeds = np.array([mixed(np.array([zlib.crc32(x.encode()) + (len(x) << 32)], dtype=np.uint64))[0] for x in langs], dtype=np.uint64)
    word = runs(lowered()[data], starts, ends)
    inside = starts - begins[text] < np.array(own)[text] if len(starts) else np.zeros(0, dtype=bool)
    return Grams(data, starts, ends, np.cumsum(of == 2)[starts], seeds[text], word, inside)


class Filter:
    """A set of fingerprints in a fixed number of bits, two bits each: it may hold more than was put in, never less."""

    def __init__(self, bits: bytes):
        import numpy as np

        self.bits = np.frombuffer(bits, dtype=np.uint8)

    def holds(self, gram):
        import numpy as np

        out = np.ones(len(gram), dtype=bool)
        for place in places(gram):
            out &= (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def places(gram):
    import numpy as np

    mask = np.uint64(FILTER_BITS - 1)
    return gram & mask, (gram >> np.uint64(33)) & mask


def frequent(docs: DataFrame, n: int, below: Filter | None, least: int) -> DataFrame:
    """``fingerprint``: those of n-grams that occur ``least`` times or more, as far as ``below``, the filter of shorter ones, lets them be counted."""

    def count(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for chunk in cut_texts(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = grams(*chunk)
                gram, ok = held.hashes(n)
                ok &= held.own
                if below is not None and len(gram) > 1:
                    shorter, _ = held.hashes(n - 1)
                    at = np.flatnonzero(ok)
                    first = below.holds(shorter[at])
                    at = at[first]
                    ok[:] = False
                    ok[at[below.holds(shorter[at + 1])]] = True
                found, times = np.unique(gram[ok], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(times.astype(np.int32))], names=["fingerprint", "times"])

    counted = docs.mapInArrow(count, "fingerprint bigint, times int").groupBy("fingerprint").agg(F.sum("times").alias("f"))
    return counted.where(F.col("f") >= least).select("fingerprint")


def filter_of(some: DataFrame) -> Filter:
    """The filter of a table of fingerprints: blocks of bits come to the driver, FILTER_BITS in all at most."""
    import numpy as np

    mask = FILTER_BITS - 1
    place = F.explode(F.array(F.col("fingerprint").bitwiseAND(F.lit(mask)), F.shiftrightunsigned("fingerprint", 33).bitwiseAND(F.lit(mask))))
    rows = some.select(place.alias("place")).select(F.shiftright("place", BLOCK_BITS.bit_length() - 1).alias("block"), F.col("place").bitwiseAND(F.lit(BLOCK_BITS - 1)).alias("bit"))

    def block(part):
        import pandas as pd

        bits = np.zeros(BLOCK_BITS, dtype=np.uint8)
        bits[part["bit"].to_numpy()] = 1
        return pd.DataFrame({"block": [part["block"].iloc[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    whole = bytearray(FILTER_BITS // 8)
    for r in rows.distinct().groupBy("block").applyInPandas(block, "block bigint, bits binary").collect():
        low = r["block"] * BLOCK_BITS // 8
        whole[low:low + BLOCK_BITS // 8] = r["bits"]
    return Filter(bytes(whole))


def word_numbers(held: Grams, some):
    """A number for each word of ``some`` (a mask), equal where the bytes are; -1 for others. A word is compared with the first of its hash, and
    those that differ get numbers of their own."""
    import numpy as np

    at = np.flatnonzero(some)
    out = np.full(len(held.word), -1, dtype=np.int64)
    _, first, member = np.unique(held.word[at], return_index=True, return_inverse=True)
    starts, size = held.starts[at], (held.ends - held.starts)[at]
    pointer = first[member]
    differs = size != size[pointer]
    live, step = np.flatnonzero(~differs & (pointer != np.arange(len(pointer)))), 0
    while len(live):
        live = live[step < size[live]]
        wrong = held.data[starts[live] + step] != held.data[starts[pointer[live]] + step]
        differs[live[wrong]] = True
        live, step = live[~wrong], step + 1
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(differs):
        member[i] = len(first) + others.setdefault(held.data[starts[i]:starts[i] + size[i]].tobytes(), len(others))
    out[at] = member
    return out


def _told_apart(words, n: int, gram, at):
    """(pointer, count) of each different phrase among the n-grams at ``at``: occurrences of a fingerprint are compared, word by word, with the
    one at its pointer; those that differ point elsewhere."""
    import numpy as np

    while len(at):
        _, first, member = np.unique(gram[at], return_index=True, return_inverse=True)
        pointer = at[first][member]
        same = np.ones(len(at), dtype=bool)
        for k in range(n):
            same &= words[at + k] == words[pointer + k]
        yield from zip(at[first].tolist(), np.bincount(member[same], minlength=len(first)).tolist())
        at = at[~same]


def materialised(docs: DataFrame, known: Filter | None, words: int, least: int) -> DataFrame:
    """``lang, n, phrase, f``: exact counts of the frequent phrases of 1 to ``words`` words, whose fingerprints are in ``known``; n = 0 counts
    a language's words."""

    def read(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for blobs, langs, own in cut_texts(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held = grams(blobs, langs, own)
                begins = np.cumsum([1, *[len(b) + 1 for b in blobs]])
                text = np.searchsorted(begins, held.starts, side="right") - 1
                rows: list[tuple[str, int, str, int]] = []
                names = np.array(langs, dtype=object)
                for lang in set(langs):
                    rows.append((lang, 0, "", int((held.own & (names[text] == lang)).sum()) if len(text) else 0))
                clean, often = held.data.tobytes(), known.holds(held.hashes(1)[0]) if known else np.zeros(len(held.word), dtype=bool)
                numbers = word_numbers(held, often)  # the words of a frequent phrase are frequent
                for n in range(1, words + 1):
                    gram, ok = held.hashes(n)
                    at = np.flatnonzero(ok & held.own & often)
                    for k in range(1, n):
                        at = at[often[at + k]]
                    at = at[known.holds(gram[at])]
                    for pointer, times in _told_apart(numbers, n, gram, at):
                        said = b" ".join(clean[held.starts[i]:held.ends[i]] for i in range(pointer, pointer + n))
                        rows.append((langs[text[pointer]], n, said.decode("utf-8", "surrogatepass"), times))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.int64()))],
                                                 names=["lang", "n", "phrase", "times"])

    counted = docs.mapInArrow(read, "lang string, n int, phrase string, times bigint").groupBy("lang", "n", "phrase").agg(F.sum("times").alias("f"))
    return counted.where((F.col("n") == 0) | (F.col("f") >= least))


def counted_phrases(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, words: int = WORDS) -> DataFrame:
    """``lang, n, phrase, f`` as ``materialised`` gives them, from length to length."""
    read = docs.select(filled(text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"))
    below, known, longest = None, None, 0
    for n in range(1, words + 1):
        some = settled(frequent(read, n, below, least), f"frequent-{n}")
        if some.isEmpty():
            break
        below, longest = filter_of(some), n
        known = below if known is None else Filter((known.bits | below.bits).tobytes())
    return materialised(read, known, longest, least)


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = LEAST, best: int = BEST) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's first ``best`` phrases of 2 to WORDS words by score.

    Score is floor(1000 a n / (l r)) at the lowest-scoring cut, in whole numbers of 38 digits. A phrase that only occurs inside one longer
    candidate is dropped. Null and empty texts have no words; null languages are ``und``; repeated rows count each. Ties rank by
    count, then by the bytes of the phrase. No rows, or none frequent, give no rows. Only text and language are read.
    """
    counts = settled(counted_phrases(docs, text=text, lang=lang, least=least), "phrase-counts")
    candidates = counts.where("n >= 2").select("lang", "phrase", F.col("n").alias("words"), F.col("f").alias("a"))
    word = F.split("phrase", " ")
    longer = candidates.where("words > 2").select("lang", "a", F.explode(F.array(
        F.array_join(F.slice(word, F.lit(1), F.col("words") - 1), " "), F.array_join(F.slice(word, F.lit(2), F.col("words") - 1), " "))).alias("phrase"))
    # A longer candidate occurs at most as often as what it holds; if any does as often, so does one with a single word more.
    inside = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = candidates.join(inside, ["lang", "phrase"], "left").where("most IS NULL OR most < a").drop("most")

    cut = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = left.select("lang", "phrase", "words", "a", cut).select(
        "lang", "phrase", "a", "k", F.array_join(F.slice(word, F.lit(1), F.col("k")), " ").alias("first"),
        F.array_join(F.slice(word, F.col("k") + 1, F.col("words") - F.col("k")), " ").alias("rest"))
    parts = counts.where("n BETWEEN 1 AND 4")
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    totals = counts.where("n = 0").select("lang", F.col("f").alias("n"))
    cuts = cuts.join(F.broadcast(totals) if totals.count() <= BROADCAST_LANGS else totals, "lang")
    whole = [F.col(c).cast("decimal(38,0)") for c in ("a", "n", "l", "r")]
    scored = cuts.withColumns({"_above": F.lit(1000).cast("decimal(4,0)") * whole[0] * whole[1], "_below": whole[2] * whole[3]})
    scored = scored.withColumn("score", F.expr("_above div _below"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("c")).select("lang", "phrase", "c.a", "c.l", "c.r", "c.n", "c.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("_salt")
    few = lowest.withColumn("_salt", salt).withColumn("rank", F.row_number().over(W.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("rank") <= best)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= best)
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH said AS (SELECT row_number() OVER () AS d, coalesce(lang, '{NO_LANG}') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
pieces AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM said),
worded AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
counts AS (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f
  FROM spots, range(1, {WORDS + 1}) AS r(m) WHERE i + m - 1 <= len(w) GROUP BY 1, 2, 3 HAVING count(*) >= {LEAST}),
totals AS (SELECT lang, count(*) AS n FROM spots GROUP BY lang),
held AS (SELECT c.lang, c.m, c.phrase, c.f AS a FROM counts c WHERE c.m >= 2 AND NOT EXISTS (
  SELECT 1 FROM counts b WHERE b.lang = c.lang AND b.m > c.m AND 100 * b.f >= 100 * c.f AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (SELECT h.*, k, string_split(phrase, ' ') AS w FROM held h, range(1, {WORDS}) AS r(k) WHERE k < m),
scored AS (SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n, CAST(1000::HUGEINT * c.a * t.n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ') JOIN totals t ON t.lang = c.lang),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {BEST}
"""
