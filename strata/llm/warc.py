"""WARC archives: a writer on Spark's text sink and a reader as a Python data source.

The writer lays every record out as one string and lets Spark's own sink write it (gzip,
commit protocol, any Hadoop store). The reader plans file partitions on the driver, takes
predicates on record type and headers, parses a record's header block first and skips over
the payload of records that no predicate wants, or whose payload nobody asked for.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from strata.llm.common import cut, drop_cut, shared_dir

SCHEMA = "warc_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload string"
#: column -> header it is read from; predicates on these are decided before a payload is touched
HEADERS = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


def _urn(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(id_.cast("string"), F.lit("")), F.lit(">"))


def write_archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", least: int = 100) -> None:
    """Write ``pages(page_id, url, html)`` as gzipped WARC files under ``path``.

    Null html is the empty payload, a null page id an empty record id, a null url leaves its header
    out. Of equal payloads of at least ``least`` bytes the smallest page id is the response and the
    others revisit it; rows that repeat that smallest id are responses too. Rows without an id
    revisit a row that has one; where no row of a group has one, all are responses.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"digest": F.sha2(F.col("html").cast("binary"), 256), "n": F.octet_length("html")})
    # only groups of two and more; written first so that its size is known when the join is planned:
    # under the session's broadcast threshold the pages stay where they are, else a skew-split merge join
    first = cut(p.filter(F.col("n") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).filter("k > 1 and first is not null").select("digest", "first"), "payloads")
    p = p.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "), F.col("n").cast("string"), F.lit(EOL * 2))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("html")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    head = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _urn(F.col("page_id"))),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.concat(F.lit("X-Payload-Bytes: "), F.col("n").cast("string")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT}{EOL}WARC-Refers-To: "), _urn(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n"))).cast("string")),
    ]
    # the sink ends a record with the second of its two line ends
    record = F.concat(F.concat_ws(EOL, *head), F.lit(EOL * 2), block, F.lit(EOL))
    p.select(record.alias("value")).write.option("lineSep", EOL).option("compression", "gzip").text(path)
    drop_cut(first)


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(path)``; option ``payload``: ``text`` (default) or ``none``,
    ``verify``: ``true`` compares payloads with their digest headers, ``split_mb``: files to a partition."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.text = options.get("payload", "text") == "text"
        self.verify = options.get("verify", "false") == "true"
        self.split = float(options.get("split_mb", 16)) * 1e6
        self.wanted: dict[str, list] = {}

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if column in HEADERS:
                self.wanted.setdefault(column, []).append(set(f.value) if isinstance(f, In) else {f.value})
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path)
        found = sorted((x for x in store.get_file_info(fs.FileSelector(root, recursive=True)) if x.is_file and x.size and not x.base_name.startswith(("_", "."))), key=lambda x: (-x.size, x.path))
        bins: list[list] = []
        for x in found:
            if bins and bins[-1][0] + x.size <= self.split:
                bins[-1][0] += x.size
                bins[-1][1].append(x.path)
            else:
                bins.append([x.size, [x.path]])
        return [Files(paths) for _, paths in bins] or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        rows, chars = [], 0
        for path in partition.paths:
            with store.open_input_stream(path, compression=None) as raw, _opened(raw, path) as f:
                for row in self.records(f):
                    rows.append(row)
                    chars += len(row[-1] or "")
                    if len(rows) >= 4096 or chars > 8_000_000:
                        yield _batch(rows)
                        rows, chars = [], 0
        if rows:
            yield _batch(rows)

    def records(self, f) -> Iterator[tuple]:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"not a WARC record: {line[:40]!r}")
            head = {}
            while (line := f.readline()).strip():
                k, _, v = line.decode().partition(":")
                head[k.strip().lower()] = v.strip()
            row = {c: head.get(h) for c, h in HEADERS.items()}
            for c in ("record_id", "refers_to"):
                row[c] = row[c] and row[c].strip("<>").removeprefix("urn:page:")
            row["payload_digest"] = row["payload_digest"] and row["payload_digest"].rpartition(":")[2]
            left = int(head["content-length"])
            if any(row[c] not in v for c, sets in self.wanted.items() for v in sets):
                _skip(f, left)
                continue
            n, payload = head.get("x-payload-bytes"), None
            if row["warc_type"] == "response" and (self.text or self.verify or n is None):
                http, _, body = f.read(left).partition(b"\r\n\r\n")
                if self.verify and hashlib.sha256(body).hexdigest() != row["payload_digest"]:
                    raise ValueError(f"record {row['record_id']}: its payload doesn't have the digest of its header")
                n, payload = len(body), body.decode(errors="replace") if self.text else None
            else:
                _skip(f, left)
            yield (*row.values(), n and int(n) if not isinstance(n, int) else n, payload)


def _opened(raw, path: str):
    return gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw


def _skip(f, n: int) -> None:
    while n > 0 and (got := f.read(min(n, 1 << 20))):
        n -= len(got)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def read_archive(spark, path: str, **options: str) -> DataFrame:
    """The records under ``path`` with columns ``SCHEMA``."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").options(**options).load(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to the shared folder, read them back; one row a page.

    Nulls are as :func:`write_archive` puts them: null html is read back as no bytes, a null page id as null. Rows that
    repeat a page id stay rows; other columns are ignored; html may be of any length. Empty table: no rows.
    """
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/strata/warc-{uuid.uuid4().hex}"
    write_archive(pages, path)
    back = read_archive(spark, path, payload="none", verify="true")
    return back.select(
        F.expr("try_cast(record_id as bigint)").alias("page_id"), "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), F.expr("try_cast(refers_to as bigint)").alias("refers_to")
    )
