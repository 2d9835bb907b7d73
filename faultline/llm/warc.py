"""Operator 5: WARC archives, read back, and the external merge of their index.

``assign`` digests the payloads and tells responses from revisits. ``write_archives`` writes WARC/1.1
files: each record is one value of Spark's text writer, whose line feed ends the record. ``read_archives``
parses the files again, by the records' own lengths. ``capture_histories`` orders the index
of all captures globally by URL key and timestamp: each file's index is a locally sorted run, ranges of
keys are dealt out by sampled bounds (a hot URL is split by timestamp and id), and in each
range a tree of losers merges the sorted runs.

Defined cases: a null payload is empty; a null URL is an empty one, and control characters and spaces leave a URL; of
equal payloads of ``min_bytes`` and more, the rows of the smallest id are responses (a null id comes
last) and the others revisit it; repeated rows are records each; captures that tie in key and timestamp
go by id, a null id last; an empty table gives an empty index; a damaged archive raises
ValueError; other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, text_bytes, written

FILE_BYTES = 16 << 20           # about, of one archive
RANGE_ROWS = 100_000            # about, of one range of the merge
_URN = "urn:faultline:page:"


def sha1_base32(column: str) -> Column:
    """Bare upper-case base32 of the SHA-1 of a string column (DataFrame functions only)."""
    hexes = F.sha1(F.encode(F.col(column), "utf-8"))
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for at in range(0, 40, 10):         # five bytes are eight letters
        bits = F.conv(F.substring(hexes, at + 1, 10), 16, 10).cast("bigint")
        parts += [F.substr(letters, (F.call_function("shiftright", bits, F.lit(35 - 5 * k)).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
                  for k in range(8)]
    return F.concat(*parts)


def assign(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
           min_bytes: int = 0, timestamp: Column | None = None) -> DataFrame:
    """(id, url, payload, bytes, digest, ts, type, refers_to): what each row's record will be.

    Without a ``timestamp`` captures are a second apart in the order of their ids.
    """
    ts = timestamp if timestamp is not None else F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce(F.col(id_col), F.lit(0)))
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
                        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"), ts.alias("ts"))
    rows = rows.withColumn("bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", sha1_base32("payload"))
    first = (rows.where(F.col("bytes") >= min_bytes).groupBy("digest", "bytes")
             .agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"))
    first = written(first, "warc-firsts")       # a known size: Spark broadcasts it only while it is small
    joined = rows.join(first, ["digest", "bytes"], "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    return joined.select("id", "url", "payload", "bytes", "digest", "ts",
                         F.when(revisit, "revisit").otherwise("response").alias("type"),
                         F.when(revisit, F.col("first_id")).alias("refers_to"))


def record() -> Column:
    """The WARC record of a row of ``assign``, without its last line feed."""
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    url = F.regexp_replace("url", r"[\x00-\x20\x7F]", "")
    revisit = F.col("type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))
    head = F.concat_ws(
        "\r\n", F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), "type"),
        F.concat(F.lit(f"WARC-Record-ID: <{_URN}"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), url), F.concat(F.lit("WARC-Date: "), time),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "digest"),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Refers-To: <{_URN}"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")))
    return F.concat(head, F.lit("\r\n\r\n"), block, F.lit("\r\n\r"))


def write_archives(assigned: DataFrame, path: str, rows: int, total: int, file_bytes: int = FILE_BYTES) -> None:
    """Gzipped archives of about ``file_bytes`` of records; ``rows`` and ``total`` bytes tell the mean record."""
    most = max(1, int(rows * file_bytes / max(1, total + 600 * rows)))
    (assigned.select(record().alias("value")).write.option("compression", "gzip")
     .option("maxRecordsPerFile", most).text(path))


def surt(url: str) -> str:
    """Sort-friendly URL key: host parts from the right, then path and query; no scheme, user, port 80/443 or fragment."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#:]*)(?::(\d+))?([^#]*)", url)
    host = m[1].lower().removeprefix("www.").rstrip(".")
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    rest = m[3] if m[3].startswith("/") else "/" + m[3]
    return ",".join(reversed(host.split("."))) + port + ")" + rest


def parse_archive(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, payload) of each record."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n") if end >= 0 else [""]
        if not lines[0].startswith("WARC/1."):
            raise ValueError(f"no record at byte {at}")
        heads = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        start = end + 4
        stop = start + int(heads["content-length"])
        if data[stop:stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} ends wrongly")
        body = data.find(b"\r\n\r\n", start, stop) + 4
        if body < start + 4:
            raise ValueError(f"the record at byte {at} has no HTTP headers")
        yield at, stop + 4 - at, heads, data[body:stop]
        at = stop + 4


def _urn(value: str | None) -> str | None:
    return (value or "").removeprefix("<" + _URN).removesuffix(">") or None


INDEX = ("url_key string, ts string, id string, type string, digest string, bytes bigint, refers_to string, "
         "file string, offset bigint, length bigint, run bigint, seq bigint")


def _reader(payloads: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                name, data, number = (batch.column(c)[row].as_py() for c in ("path", "content", "run"))
                if name.endswith(".gz"):
                    data = gzip.decompress(data)
                entries = []
                for offset, length, heads, payload in parse_archive(data):
                    response = heads["warc-type"] == "response"
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode() if response else None
                    if response and heads["warc-payload-digest"] != "sha1:" + digest:
                        raise ValueError(f"{name}: the payload at byte {offset} doesn't have its digest")
                    http = data[offset:offset + length].rpartition(b"Content-Length: ")[2] if not response else b""
                    size = len(payload) if response else int(http.split(b"\r", 1)[0])
                    entries.append((surt(heads["warc-target-uri"]), heads["warc-date"], _urn(heads["warc-record-id"]),
                                    heads["warc-type"], heads["warc-payload-digest"].removeprefix("sha1:"), size,
                                    _urn(heads.get("warc-refers-to")), name, offset, length, number, payload))
                entries.sort(key=_order)                        # the file's index is one sorted run
                columns = list(zip(*entries, strict=True)) or [()] * 12
                kinds = [pa.string()] * 5 + [pa.int64()] + [pa.string()] * 2 + [pa.int64()] * 3
                out = [pa.array(c, k) for c, k in zip(columns[:11], kinds, strict=True)] + [pa.array(range(len(entries)), pa.int64())]
                names = INDEX_NAMES
                if payloads:
                    out.append(pa.array(columns[11], pa.binary()))
                    names = [*names, "payload"]
                yield pa.RecordBatch.from_arrays(out, names=names)
    return run


def _order(entry: tuple) -> tuple:
    """URL key, timestamp, then id: numbers by value, others after them, none last."""
    i = entry[2]
    return entry[0], entry[1], i is None, not (i or "").lstrip("-").isdigit(), int(i) if i and i.lstrip("-").isdigit() else 0, i or ""


INDEX_NAMES = [x.split()[0] for x in INDEX.split(", ")]


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives under ``path``: index columns, and the payloads if wanted.

    Digests of payloads are checked. A revisit holds no payload; its size is that of its HTTP headers.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.xxhash64("path").alias("run"))
    return files.mapInArrow(_reader(payloads), INDEX + (", payload binary" if payloads else ""))


class LoserTree:
    """K-way merge of sorted runs: each inner node keeps the loser of its match, the root's winner goes out."""

    def __init__(self, runs: list[Iterator], key):
        self.key, self.runs = key, runs
        self.heads: list = [None] * len(runs)
        self.keys: list = [None] * len(runs)
        for i in range(len(runs)):
            self._next(i)
        self.tree = [-1] * max(1, len(runs))
        for i in range(len(runs)):
            self._replay(i)

    def _next(self, i: int) -> None:
        self.heads[i] = next(self.runs[i], None)
        self.keys[i] = None if self.heads[i] is None else (self.key(self.heads[i]), i)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run ``a`` goes before run ``b``; empty places (below zero) win while the tree fills."""
        if a < 0 or b < 0:
            return a < 0
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and self.keys[a] is not None
        return self.keys[a] < self.keys[b]

    def _replay(self, i: int) -> None:
        node = (i + len(self.runs)) // 2
        while node > 0:
            if self._beats(self.tree[node], i):
                i, self.tree[node] = self.tree[node], i
            node //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while self.runs and (i := self.tree[0]) >= 0 and self.heads[i] is not None:
            yield self.heads[i]
            self._next(i)
            self._replay(i)


def _merger(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs: dict[int, list[tuple]] = {}
    schema = None
    for batch in batches:               # one range of keys, bounded by the number of ranges
        schema = batch.schema
        for entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            runs.setdefault(entry[10], []).append(entry)
    if schema is None:
        return
    for run in runs.values():
        run.sort(key=lambda e: e[11])   # slices of a run may arrive in any order
    part: list[tuple] = []
    for entry in LoserTree([iter(runs[r]) for r in sorted(runs)], _order):
        part.append(entry)
        if len(part) >= 10_000:
            yield _batch(part, schema)
            part = []
    if part:
        yield _batch(part, schema)


def _batch(entries: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*entries, strict=True), schema)], schema=schema)


def capture_histories(index: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The index in global order of URL key, timestamp and id: partitions in order, and rows in them."""
    spark = index.sparkSession
    runs = written(index, "warc-runs")
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_rows))
    number = F.expr("try_cast(id as bigint)")
    dealt = runs.repartitionByRange(ranges, "url_key", "ts", F.col("id").isNull(), number.isNull(), number, "id", "file", "offset")
    return dealt.mapInArrow(_merger, INDEX)


def archive(pages: DataFrame, path: str | None = None, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
            min_bytes: int = 0) -> str:
    """Write the pages' archives to ``path`` (a fresh folder of the shared ones by default); returns the path."""
    path = path or scratch(pages.sparkSession, "warc")
    total, rows = text_bytes(pages, payload_col), pages.count()
    write_archives(assign(pages, id_col, url_col, payload_col, min_bytes), path, rows, total)
    return path
