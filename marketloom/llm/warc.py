"""WARC archives and an external merge of their index.

Archives are written by Spark's text writer, one record per row; the record's closing blank lines are the row separator, so a
file is a WARC file, compressed as a whole, wherever the shared folder is; offsets are those of its plain bytes. A task starts a new
file after ARCHIVE_BYTES, so files are bounded by bytes, not by pages. Equal payloads of some size are stored once: the smallest page
id of a digest is the response, found by a combinable minimum and a join, and the others are revisit records.

Reading parses each archive in one pass and yields its index entries sorted by URL key and time: a sorted run per
archive. The runs are exchanged by key range; each task then merges its k run segments with a loser tree, so that the partitions
together hold one globally ordered capture history.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm.tables import filled, settled, table
from marketloom.session import fresh_path

LEAST_SHARED = 100  # bytes from which an equal payload is stored once
ARCHIVE_BYTES = 64 << 20  # of records in a file, before compression; a larger record is a file of its own
MERGED = 200_000  # index entries of a key range, about: one task merges them in memory
EPOCH = 1_704_067_200  # captures without a time: this second plus the page id, within SPAN seconds
SPAN = 1 << 30
CRLF = "\r\n"
ENTRY = ("url_key string, captured string, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, "
         "refers_to bigint, archive string, offset bigint, record_bytes bigint")


def url_key(url: Column) -> Column:
    """Sort-friendly form: host labels reversed and comma-joined, ``)``, then the rest in lower case; no scheme, no ``www.``, no fragment."""
    plain = F.regexp_replace(F.lower(url), "^[a-z][a-z0-9+.-]*://(www[0-9]*\\.)?|#.*$", "")
    host = F.regexp_extract(plain, "^([^/?]*)", 1)
    rest = F.regexp_extract(plain, "^[^/?]*(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), F.when(rest == "", "/").otherwise(rest))


def _header(name: str, value: Column) -> Column:
    """A header line, or nothing for null; line breaks in a value are percent-encoded."""
    clean = F.replace(F.replace(value.cast("string"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF)), F.lit(""))


def records(pages: DataFrame, *, key: str = "page_id", url: str = "url", html: str = "html", captured: str | None = None) -> DataFrame:
    """``record``: the text of one WARC record per row, without the two line breaks that close it."""
    stamp = F.col(captured) if captured else F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce(F.col(key).cast("bigint"), F.lit(0)), F.lit(SPAN)))
    rows = pages.select(
        F.col(key).cast("bigint").alias("page_id"), F.col(url).alias("url"), filled(html).alias("html"),
        F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("captured"))
    body = F.col("html").cast("binary")
    rows = rows.withColumns({"bytes": F.octet_length("html").cast("bigint"), "digest": F.sha2(body, 256)})
    shared = rows.where(F.col("bytes") >= LEAST_SHARED).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first"))
    shared = settled(shared.where("n > 1").select(F.col("digest").alias("_digest"), "first"), "shared-payloads")
    rows = rows.join(shared, rows["digest"] == shared["_digest"], "left")
    rows = rows.withColumn("refers_to", F.when(F.coalesce(F.col("page_id") != F.col("first"), F.col("first").isNotNull()), F.col("first")))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, F.lit("HTTP/1.1 200 OK" + CRLF + CRLF)).otherwise(F.concat(
        F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.col("bytes").cast("string"),
        F.lit(CRLF + CRLF), F.col("html")))
    rows = rows.withColumn("block", block)
    identity = F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))
    head = F.concat(
        F.lit("WARC/1.1" + CRLF), _header("WARC-Type", F.when(revisit, "revisit").otherwise("response")), _header("WARC-Record-ID", identity),
        _header("WARC-Date", F.col("captured")), _header("WARC-Target-URI", F.col("url")),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Profile", F.when(revisit, "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _header("X-Page-Id", F.col("page_id")), _header("X-Refers-To-Page-Id", F.col("refers_to")), _header("X-Payload-Length", F.col("bytes")),
        _header("Content-Type", F.lit("application/http; msgtype=response")), _header("Content-Length", F.octet_length("block")), F.lit(CRLF))
    return rows.select(F.concat(head, F.col("block")).alias("record"))


def write(pages: DataFrame, path: str, **columns) -> None:
    """Archives below ``path``, of at most ARCHIVE_BYTES plain bytes or one record each."""

    def numbered(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        number, held = 0, 0
        for batch in batches:
            own = np.zeros(batch.num_rows, dtype=np.int64)
            for i, size in enumerate(pc.binary_length(batch.column(0)).to_numpy(zero_copy_only=False)):
                if held and held + size > ARCHIVE_BYTES:
                    number, held = number + 1, 0
                held += int(size) + 4
                own[i] = number
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own)], names=["record", "file"])

    cut = records(pages, **columns).mapInArrow(numbered, "record string, file bigint")
    cut.write.partitionBy("file").option("lineSep", CRLF * 2).option("compression", "gzip").text(path)


def parsed(content: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of the records of one archive."""
    at = 0
    while at < len(content):
        head_end = content.index(b"\r\n\r\n", at)
        lines = content[at:head_end].decode("utf-8", "replace").split(CRLF)
        headers = dict(line.split(": ", 1) for line in lines[1:])
        start = head_end + 4
        end = start + int(headers["Content-Length"])
        yield at, end + 4 - at, headers, content[start:end]
        at = end + 4


def index_runs(spark: SparkSession, path: str) -> DataFrame:
    """Index entries read back from the archives below ``path``; each archive's are a run sorted by key, time and page.

    Payload length and digest of a response are those of the bytes read; a revisit states those of the payload it refers to.
    """

    def read(batches: Iterator) -> Iterator:
        import gzip
        import hashlib

        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = []
                for offset, length, headers, block in parsed(gzip.decompress(content)):
                    number = lambda key: int(headers[key]) if key in headers else None
                    if headers["WARC-Type"] == "response":
                        payload = block[block.index(b"\r\n\r\n") + 4:]
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                    else:
                        size, digest = number("X-Payload-Length"), headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    rows.append((headers.get("WARC-Date"), number("X-Page-Id"), headers.get("WARC-Target-URI"), headers["WARC-Type"], size, digest,
                                 number("X-Refers-To-Page-Id"), name, offset, length))
                frame = pd.DataFrame(rows, columns=["captured", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to",
                                                    "archive", "offset", "record_bytes"])
                for column in ("page_id", "refers_to"):
                    frame[column] = pd.array([r[{"page_id": 1, "refers_to": 6}[column]] for r in rows], dtype="Int64")
                yield frame

    schema = ENTRY.replace("url_key string, ", "")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    entries = files.mapInPandas(read, schema).withColumn("url_key", F.coalesce(url_key(F.col("url")), F.lit("")))
    return entries.select(*[c.split(" ")[0] for c in ENTRY.split(", ")]).sortWithinPartitions("archive", *ORDER)


ORDER = ["url_key", "captured", "page_id", "offset"]


class LoserTree:
    """Merges sorted runs: every inner node keeps the loser of its match, so the next smallest costs one path of matches."""

    def __init__(self, heads: list):
        self.size = max(1, len(heads))
        self.heads = heads  # None: the run has ended
        self.losers = [-1] * self.size
        self.winner = self._play(1) if heads else -1

    def _before(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[b] is None
        return (self.heads[a], a) < (self.heads[b], b)

    def _play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        left, right = self._play(2 * node), self._play(2 * node + 1)
        won, lost = (left, right) if self._before(left, right) else (right, left)
        self.losers[node] = lost
        return won

    def advance(self, head) -> None:
        """Replace the winner's head (None at its end) and play its path again."""
        won = self.winner
        self.heads[won] = head
        node = (won + self.size) // 2
        while node >= 1:
            if self._before(self.losers[node], won):
                won, self.losers[node] = self.losers[node], won
            node //= 2
        self.winner = won


def merged_order(runs: list[list[tuple]]) -> Iterator[tuple[int, int]]:
    """(run, place) of all items in merged order; the runs are sorted, ties go to the earlier run."""
    tree = LoserTree([run[0] if run else None for run in runs])
    place = [0] * len(runs)
    while tree.winner >= 0 and tree.heads[tree.winner] is not None:
        run = tree.winner
        yield run, place[run]
        place[run] += 1
        tree.advance(runs[run][place[run]] if place[run] < len(runs[run]) else None)


def merged_history(runs: DataFrame) -> DataFrame:
    """All index entries, in global order of URL key, time and page over the partitions. Ranges are of the whole order, so one URL with very many
    captures is cut as well."""

    def merge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held = list(batches)
        if not held:
            return
        entries = pa.Table.from_batches(held)
        column = {name: entries.column(name).to_pylist() for name in (*ORDER, "archive")}
        keys = [(key.encode(), time or "", page is not None, page or 0, offset) for key, time, page, offset in zip(*(column[name] for name in ORDER))]
        segments: dict[str, list[list[int]]] = {}
        for i, archive in enumerate(column["archive"]):  # a run comes in one or a few blocks, each in order
            blocks = segments.setdefault(archive, [[]])
            if blocks[-1] and keys[i] < keys[blocks[-1][-1]]:
                blocks.append([])
            blocks[-1].append(i)
        order = [block for name in sorted(segments) for block in segments[name]]
        ranked = [order[run][place] for run, place in merged_order([[keys[i] for i in segment] for segment in order])]
        yield from entries.take(ranked).combine_chunks().to_batches()

    parts = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // MERGED))
    return runs.repartitionByRange(parts, *ORDER).mapInArrow(merge, ENTRY)


def captured(pages: DataFrame, path: str, **columns) -> DataFrame:
    """Write the archives below ``path``, read them back and return the merged capture history.

    Null html is an empty payload; a null url has no target and the empty key; a null page id has no id header, is never referred to and, where
    its payload has an id elsewhere, refers to that. Rows that repeat the smallest page id of a payload are all responses. No pages give
    no archives and no rows. Only the named columns are read.
    """
    write(pages, path, **columns)
    runs = settled(index_runs(pages.sparkSession, path), "index-runs")
    return merged_history(runs)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = captured(table(spark, sf_dir, "pages"), fresh_path(spark, "archives"))
    return history.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("captured").alias("captured_at"))


OP8_SQL = f"""
WITH stored AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
firsts AS (SELECT *, CASE WHEN payload_bytes >= {LEAST_SHARED} THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM stored)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to,
  strftime(make_timestamp(({EPOCH} + page_id % {SPAN}) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS captured_at FROM firsts
"""
