"""Packing by concatenate and cut.

Pass one tokenises every document once, in the order in which the files hold them, and notes where each document starts
inside its unit (a block of an input file). The units' token totals, one row each, turn by a prefix sum into global
offsets. Pass two is a map: a document's global interval is cut at multiples of the sequence length, so a document that
crosses a boundary leaves one record on either side and only the last sequence of all is short.

The vocabulary is read by ``tiktoken``, which gives the ids of the ``tokenizers`` file (tests compare them) in a quarter of
the time. Its splitting has a stack that runs of about a million white spaces overflow; such a text is read by ``tokenizers``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketloom.llm.tables import filled, settled, table

SEQUENCE = 1024
SEPARATOR = 0  # id that ends a document
END_OF_TEXT = ("<|endoftext|>", 50256)  # the one special token: its text in a document is that id
BROADCAST_UNITS = 200_000  # rows of about 200 bytes; with more units the offsets are joined by a shuffle
VOCABULARY = "byte_bpe_50k.tiktoken"

TOKENS = "unit string, block bigint, local_start bigint, doc_id bigint, doc_tokens bigint, ids binary"


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@lru_cache(maxsize=2)
def encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict([END_OF_TEXT]))


@lru_cache(maxsize=2)
def slow_encoding(path: str):
    """The same vocabulary, from the ``tokenizers`` file beside it: for texts that overflow the stack of ``encoding``."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json")


def ids_of(text: str, path: str):
    import numpy as np

    try:
        return encoding(path).encode_to_numpy(text, allowed_special={END_OF_TEXT[0]}).astype("<u4")
    except ValueError as error:
        if "stack" not in str(error):
            raise
        return np.array(slow_encoding(path).encode(text, add_special_tokens=False).ids, dtype="<u4")


def tokenised(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row per document: its unit, where it starts there, and its ids (little-endian unsigned 32-bit) with the separator."""
    path = vocabulary or vocabulary_path()
    own = F.col(key).cast("bigint").alias("doc_id"), filled(text).alias("text")
    try:
        read = docs.select(F.col("_metadata.file_path").alias("unit"), F.col("_metadata.file_block_start").alias("block"), *own)
    except AnalysisException:  # not straight from files: the order is that of the partitions
        read = docs.select(F.lit("").alias("unit"), F.spark_partition_id().cast("bigint").alias("block"), *own)

    def encode(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last = np.array([SEPARATOR], dtype="<u4").tobytes()
        unit, total = None, 0
        for batch in batches:
            starts, sizes, blobs = [], [], []
            for name, block, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
                if (name, block) != unit:
                    unit, total = (name, block), 0
                blob = ids_of(words, path).tobytes() + last
                starts.append(total)
                sizes.append(len(blob) // 4)
                blobs.append(blob)
                total += sizes[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(starts, pa.int64()), batch.column(2), pa.array(sizes, pa.int64()), pa.array(blobs, pa.binary())],
                names=["unit", "block", "local_start", "doc_id", "doc_tokens", "ids"])

    return read.mapInArrow(encode, TOKENS)


def placed(tokens: DataFrame) -> DataFrame:
    """Adds ``global_start``: the ids before a document in the whole corpus, by units in file order."""
    totals = settled(tokens.groupBy("unit", "block").agg(F.sum("doc_tokens").alias("total")), "unit-totals")
    before = W.orderBy("unit", "block").rowsBetween(W.unboundedPreceding, -1)  # one row per unit
    offsets = totals.select("unit", "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("unit_start"))
    if totals.count() <= BROADCAST_UNITS:
        offsets = F.broadcast(offsets)
    return tokens.join(offsets, ["unit", "block"]).withColumn("global_start", F.col("unit_start") + F.col("local_start"))


def _slice(start: Column, length: Column) -> Column:
    return F.substring(F.col("ids"), (start * 4 + 1).cast("int"), (length * 4).cast("int"))


def pieces(docs: DataFrame, *, size: int = SEQUENCE, with_ids: bool = False, **reading) -> DataFrame:
    """Every document's pieces, one row each: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    Null and empty texts are one separator. Rows that repeat are packed again. A null ``doc_id`` stays null. An empty table
    gives no rows. Only the key, the text and the file position are read, so other columns cannot clash.
    """
    laid = placed(settled(tokenised(docs, **reading), "tokens"))
    first, end = F.col("global_start"), F.col("global_start") + F.col("doc_tokens")

    def cut(sequence: Column) -> Column:
        low, high = F.greatest(sequence * size, first), F.least((sequence + 1) * size, end)
        own = _slice(low - first, high - low)
        fields = [(low - first).alias("start"), (high - low).alias("length"), F.crc32(own).alias("ids_crc32"),
                  sequence.alias("sequence_id"), (low - sequence * size).alias("offset")]
        return F.struct(*fields, *([own.alias("ids")] if with_ids else []))

    runs = F.sequence(F.floor(first / size), F.floor((end - 1) / size))
    cuts = laid.select("doc_id", "doc_tokens", F.explode(F.transform(runs, cut)).alias("p"))
    return cuts.select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset", *(["p.ids"] if with_ids else []))


def sequences(cut: DataFrame, *, size: int = SEQUENCE, pad: int = SEPARATOR) -> DataFrame:
    """Training sequences from ``pieces(..., with_ids=True)``: ``sequence_id``, ``length`` and ``ids`` (binary, as in the pieces).

    Sequences are padded to ``size``, except one whose length is a power of two. At most ``size`` ids meet in a group.
    """
    joined = cut.groupBy("sequence_id").agg(
        F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("parts"))
    whole = F.array_join(F.col("parts.ids"), "")
    short = (F.col("length") < size) & (F.col("length").bitwiseAND(F.col("length") - 1) != 0)
    filler = F.repeat(F.lit(pad.to_bytes(4, "little").hex()), F.when(short, size - F.col("length")).otherwise(0).cast("int"))
    return joined.select("sequence_id", "length", F.unhex(F.concat(whole, filler)).alias("ids"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces(table(spark, sf_dir, "documents"))
