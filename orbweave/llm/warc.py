"""WARC archives through a chunked record table.

Writing: a record is one or more rows (record, chunk number, text), each a WARC record of at most CHUNK characters of
payload: the first is `response` (or `revisit`), the others are WARC 1.1 `continuation` segments of it. Spark's text
writer puts them in gzip files whose line separator is the end of a WARC record, so archives land in any store that Spark
can write to, and no task holds more than a chunk beside the row it reads.

Reading: a gzip file is read by one task from its start to its end. Spark's text reader cuts it at the same separator; the
parser joins what belongs together by the records' lengths (the separator may well occur in a payload), and gives a row for
each chunk with the digest and the length of the payload up to there. The last chunk's row has those of the whole payload.

Duplicates: of records with equal payloads of at least MIN_REVISIT bytes that with the smallest id is stored, others refer
to it. Only digests and ids are grouped. The first ids of digests that repeat are saved and measured: up to BROADCAST bytes payloads stay where
they are; beyond that they move once, to their digest's first id, and as that table has one row for each digest, Spark's skew
join handling can split a hot digest. Long payloads are cut in two steps, first into spans of about the square root of their
chunks, so that no chunk is searched from the payload's start.

Defined cases. Null payload: empty, a response. Null id: written as such; it is smallest only if all ids are null.
Rows that repeat the smallest id are all responses. Null urls are left out, those with spaces or control characters percent-encoded. Other columns are
ignored. An empty table: no archive, no rows. Very long payloads: cut into chunks. A segment that is lost or out of place, a record that ends early
and a payload that its digest doesn't fit are errors, never skipped.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_path, saved, table

#: Characters of a payload in a row, and the least bytes for which a revisit is written.
CHUNK, MIN_REVISIT = 1 << 18, 100
#: Bytes of the repeated digests up to which they are broadcast.
BROADCAST = 16 << 20
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
DATE = "1970-01-01T00:00:00Z"


def described(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """id, url, payload, n_bytes, digest, first: the id that holds the same payload first (null if the record is a response)."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("n_bytes", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    firsts = rows.where(F.col("n_bytes") >= MIN_REVISIT).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("_n")).where("_n > 1 and first is not null").drop("_n")
    firsts = saved(firsts, "warc-firsts")
    size = firsts.select(F.sum(F.octet_length("digest") + F.octet_length(F.col("first").cast("string")))).first()[0] or 0
    return rows.join(F.broadcast(firsts) if size <= BROADCAST else firsts, "digest", "left").withColumn("first", F.when(~F.col("first").eqNullSafe(F.col("id")), F.col("first")))


def _field(name: str, value: str | Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), F.lit(value) if isinstance(value, str) else value.cast("string"), F.lit("\r\n")), F.lit(""))


def chunk_rows(rows: DataFrame) -> DataFrame:
    """The chunked record table of what described() gives: id, chunk (from 0), text: a WARC record without its end."""
    stored = F.col("first").isNull()
    n = F.when(stored, F.greatest(F.ceil(F.char_length("payload") / CHUNK), F.lit(1))).otherwise(1).cast("int")
    rows = rows.withColumn("chunks", n).withColumn("_each", F.ceil(F.sqrt("chunks")).cast("int"))
    rows = rows.withColumn("_span", F.explode(F.sequence(F.lit(0), F.floor((F.col("chunks") - 1) / F.col("_each")).cast("int"))))
    rows = rows.withColumn("payload", F.when(F.col("chunks") > 1, F.substr("payload", F.col("_span") * F.col("_each") * CHUNK + 1, F.col("_each") * CHUNK)).otherwise(F.col("payload")))
    rows = rows.withColumn("_at", F.explode(F.sequence(F.lit(0), F.least(F.col("chunks") - F.col("_span") * F.col("_each"), F.col("_each")) - 1)))
    rows = rows.withColumn("chunk", F.col("_span") * F.col("_each") + F.col("_at"))
    body = F.when(stored, F.when(F.col("chunks") > 1, F.substr("payload", F.col("_at") * CHUNK + 1, F.lit(CHUNK))).otherwise(F.col("payload"))).otherwise("")
    first = F.col("chunk") == 0
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    block = F.when(first, F.concat(F.lit(HTTP), F.col("_body"))).otherwise(F.col("_body"))
    many = F.col("chunks") > 1
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        F.when(~first, _field("WARC-Type", "continuation")).otherwise(F.when(stored, _field("WARC-Type", "response")).otherwise(_field("WARC-Type", "revisit"))),
        _field("WARC-Record-ID", F.when(first, name(F.col("id"))).otherwise(F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(":"), F.col("chunk").cast("string"), F.lit(">")))),
        _field("WARC-Date", DATE),
        F.when(first, _field("WARC-Target-URI", F.when(F.col("url").rlike(r"[\x00-\x20\x7F]"), F.url_encode(F.col("url"))).otherwise(F.col("url")))).otherwise(""),
        F.when(first, _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))).otherwise(""),
        F.when(~stored, _field("WARC-Refers-To", name(F.col("first")))).otherwise(""),
        F.when(~stored, _field("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")).otherwise(""),
        F.when(first, _field("X-Payload-Length", F.col("n_bytes"))).otherwise(""),
        F.when(many, _field("WARC-Segment-Number", F.col("chunk") + 1)).otherwise(""),
        F.when(many & ~first, _field("WARC-Segment-Origin-ID", name(F.col("id")))).otherwise(""),
        F.when(many, _field("X-Segments", F.col("chunks"))).otherwise(""),
        F.when(many & (F.col("chunk") + 1 == F.col("chunks")), _field("WARC-Segment-Total-Length", F.lit(len(HTTP)) + F.col("n_bytes"))).otherwise(""),
        _field("Content-Type", "application/http;msgtype=response"),
        F.lit("Content-Length: "),
        F.octet_length("_block").cast("string"),
        F.lit(END),
    )
    return rows.withColumn("_body", body).withColumn("_block", block).select("id", "chunk", F.concat(head, F.col("_block")).alias("text"))


def write_archives(pages: DataFrame, path: str, **columns: str) -> None:
    """Writes a record for each page under path, a .warc-formatted gzip file for each partition."""
    chunk_rows(described(pages, **columns)).select("text").write.option("lineSep", END).option("compression", "gzip").text(path)


class Parser:
    """Chunk rows from the pieces between separators of one archive, in their order."""

    def __init__(self) -> None:
        self.head: dict[str, str] = {}
        self.left = -1  # bytes of the block to come; -1: a header comes
        self.kept = b""  # of a header
        self.skip = False  # the HTTP header is still to come
        self.sha = hashlib.sha256()
        self.done = self.size = self.chunk = 0
        self.record: dict[str, str] = {}
        self.open = False  # more of the record is to come

    def feed(self, data: bytes) -> Iterator[tuple]:
        while data:
            if self.left < 0:
                self.kept += data
                at = self.kept.find(b"WARC/")
                end = self.kept.find(END.encode(), max(at, 0))
                if at < 0 or end < 0:
                    self.kept = self.kept[-8:] if at < 0 else self.kept
                    return
                lines, data, self.kept = self.kept[at:end].decode("utf-8", "replace").split("\r\n")[1:], self.kept[end + len(END) :], b""
                self.head = dict(x.split(": ", 1) for x in lines if ": " in x)
                self.left, self.size = int(self.head.get("Content-Length", 0)), 0
                if self.head.get("WARC-Type") == "continuation":
                    if not self.open or int(self.head.get("WARC-Segment-Number", 0)) != self.chunk + 1 or self.head.get("WARC-Segment-Origin-ID") != self.record.get("WARC-Record-ID"):
                        raise ValueError(f"segment {self.head.get('WARC-Record-ID')} doesn't follow the one before it")
                else:
                    if self.open:
                        raise ValueError(f"record {self.record.get('WARC-Record-ID')} isn't whole")
                    self.open = True
                    self.record, self.skip, self.sha, self.done, self.chunk = self.head, self.head["WARC-Type"] in ("response", "revisit"), hashlib.sha256(), 0, 0
                self.http = b""
            part, data = data[: self.left], data[self.left :]
            self.left -= len(part)
            if self.skip:
                self.http += part
                if (end := self.http.find(END.encode())) >= 0:
                    part, self.skip = self.http[end + len(END) :], False
                else:
                    part = b""
            self.sha.update(part)
            self.done += len(part)
            self.size += len(part)
            if self.left == 0:
                self.left = -1
                yield self.row()
                self.chunk += 1
            elif not data:
                return

    def finish(self) -> None:
        """Called at the end of an archive."""
        if self.open or self.left > 0:
            raise ValueError(f"record {self.record.get('WARC-Record-ID')} isn't whole")

    def row(self) -> tuple:
        r, whole = self.record, int(self.record.get("X-Segments", 1)) == self.chunk + 1
        self.open = not whole
        if whole and r["WARC-Type"] == "response" and r["WARC-Payload-Digest"] != f"sha256:{self.sha.hexdigest()}":
            raise ValueError(f"record {r['WARC-Record-ID']}: its payload's digest is another")
        name = lambda x: (m := re.fullmatch(r"<urn:page:(.*)>", x or "")) and (None if m[1] == "null" else m[1])
        if r["WARC-Type"] == "revisit":  # the payload is the one it refers to
            return name(r["WARC-Record-ID"]), 0, 0, int(r["X-Payload-Length"]), r["WARC-Payload-Digest"].removeprefix("sha256:"), "revisit", name(r.get("WARC-Refers-To")), True
        return name(r["WARC-Record-ID"]), self.chunk, self.size, self.done, self.sha.hexdigest(), r["WARC-Type"], None, whole


READ = "id string, chunk int, chunk_bytes long, payload_bytes long, payload_digest string, record_type string, refers_to string, last boolean"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each chunk: id, chunk, chunk_bytes; payload_bytes and payload_digest of the payload up to its end; last."""
    spark_schema = T._parse_datatype_string(READ)
    arrow = pa.schema([(f.name, {"string": pa.string(), "integer": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}[f.dataType.typeName()]) for f in spark_schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsers: dict[str, Parser] = {}
        for batch in batches:
            out = []
            for file, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file not in parsers:
                    for p in parsers.values():
                        p.finish()
                    parsers = {file: Parser()}
                out += parsers[file].feed((text or b"") + END.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)
        for p in parsers.values():
            p.finish()

    return spark.read.option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).mapInArrow(run, spark_schema)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    whole = read_archives(spark, path).where("last")
    return whole.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


ORACLE = r"""
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first_id, count(*) as n from p where payload_bytes >= 100 group by payload_digest)
select p.page_id, p.payload_bytes, p.payload_digest,
       case when n > 1 and first_id is distinct from p.page_id then 'revisit' else 'response' end as record_type,
       case when n > 1 and first_id is distinct from p.page_id then first_id end as refers_to
from p left join f using (payload_digest)
"""
