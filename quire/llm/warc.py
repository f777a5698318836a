"""WARC archives as chunk rows: records are written as segments of bounded size and read back as a stream of chunks.

Writing is one query: a record's block is cut into chunks of ``chunk`` bytes, each chunk becomes a WARC segment (the first a
``response``, the rest ``continuation`` records, numbered, the last with the total length), and Spark's text writer puts them
into gzip files, with the blank lines that end a WARC record as line separator. Any store that Spark writes to will do.
Reading splits the files at blank lines, restores the byte stream and follows Content-Length, so that a payload may hold blank
lines; it yields one row for each chunk (record id, chunk number) with the digest of the payload up to there. Reading holds no more of
a record than one chunk and one digest state. Writing holds the input's own cell, which is a whole payload, and while a record is
cut that payload once more behind its HTTP header and once more as its chunks.

Equal payloads of ``revisit_from`` bytes or more are stored once: the row with the largest id is the response, the others are
revisit records that name it. A payload's digest is compared while reading; a wrong one is an error.

Defined cases: a null payload is empty; a null id is written without a key, read back as null, and is smaller than any other;
rows that repeat an id and payload share a record id (all of the largest id are responses); control characters are left out of
a target URI and a null one is ``about:blank``; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.session import shared_folder

BLANK = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed: Column) -> Column:
    """Base 32 of 40 hex digits, five of them (four letters) at a time."""
    letters = []
    for at in range(1, 41, 5):
        value = F.conv(F.substring(hexed, at, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(_BASE32), F.shiftright(value, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def _uuid(*parts: Column) -> Column:
    md5 = F.md5(F.concat_ws("\u001f", *parts))
    cut = [F.substring(md5, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *cut))


def _named(key: str) -> Column:
    """A name of a key that no other key has, null included."""
    return F.coalesce(F.concat(F.lit("="), key), F.lit("-"))


def _header(**fields: Column) -> Column:
    """The header block; a field whose value is null is left out."""
    lines = [F.concat(F.lit(f"\r\n{k.replace('_', '-')}: "), v.cast("string")) for k, v in fields.items()]
    return F.concat(F.lit("WARC/1.1"), *[F.coalesce(x, F.lit("")) for x in lines])


def segments(rows: DataFrame, id_col: str, uri_col: str, payload_col: str, chunk: int = 1 << 18, revisit_from: int = 0) -> DataFrame:
    """One binary ``segment`` for each chunk of each record, in order within a partition."""
    # two rows of one id hold the payload once more only if they repeat each other, so the id and digest are the join's key
    given = rows.select(F.col(id_col).cast("string").alias("key"), F.col(id_col).alias("id"), F.col(uri_col).cast("string").alias("uri"), F.coalesce(F.col(payload_col).cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    given = given.withColumns({"sha1": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")})
    small = given.select("key", "id", "sha1", "bytes")
    firsts = small.where(F.col("bytes") >= revisit_from).groupBy("sha1").agg(F.max("id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    again = small.join(firsts, "sha1").where(F.col("id").isNull() | (F.col("id") < F.col("first"))).select(_named("key").alias("again"), F.col("sha1").alias("again_sha1"), "first").distinct()
    joined = given.join(again, (_named("key") == F.col("again")) & (F.col("sha1") == F.col("again_sha1")), "left")
    refers = F.col("first").cast("string")
    record = _uuid(_named("key"), F.col("sha1"))
    block = F.when(refers.isNull(), F.concat(F.lit(HTTP).cast("binary"), "payload")).otherwise(F.lit(b""))
    numbered = joined.withColumns({"record": record, "refers": refers, "block": block, "digest": F.concat(F.lit("sha1:"), base32(F.col("sha1")))})
    numbered = numbered.withColumn("last", F.greatest(F.ceil(F.octet_length("block") / F.lit(chunk)), F.lit(1)).cast("int"))
    cut = F.transform(F.sequence(F.lit(1), F.col("last")), lambda i: F.substring(F.col("block"), (i - 1) * chunk + 1, F.lit(chunk)))
    parts = numbered.withColumn("pieces", cut).drop("block", "payload").select("*", F.posexplode("pieces").alias("at", "piece")).drop("pieces").withColumn("at", F.col("at") + 1)
    first, many = F.col("at") == 1, F.col("last") > 1
    uri = F.coalesce(F.regexp_replace("uri", r"[\x00-\x20\x7f]", ""), F.lit("about:blank"))
    header = _header(
        WARC_Type=F.when(~first, F.lit("continuation")).when(F.col("refers").isNull(), F.lit("response")).otherwise(F.lit("revisit")),
        WARC_Record_ID=F.concat(F.lit("<"), F.when(first, F.col("record")).otherwise(_uuid(F.col("record"), F.col("at").cast("string"))), F.lit(">")),
        WARC_Date=F.lit(DATE),
        WARC_Target_URI=uri,
        Content_Type=F.when(F.col("refers").isNull(), F.lit("application/http; msgtype=response")),
        Content_Length=F.octet_length("piece"),
        WARC_Payload_Digest=F.when(first, F.col("digest")),
        WARC_Profile=F.when(F.col("refers").isNotNull(), F.lit(PROFILE)),
        WARC_Refers_To=F.when(F.col("refers").isNotNull(), F.concat(F.lit("<"), _uuid(_named("refers"), F.col("sha1")), F.lit(">"))),
        WARC_Segment_Number=F.when(many, F.col("at")),
        WARC_Segment_Origin_ID=F.when(~first, F.concat(F.lit("<"), F.col("record"), F.lit(">"))),
        WARC_Segment_Total_Length=F.when(many & (F.col("at") == F.col("last")), F.octet_length(F.lit(HTTP)) + F.col("bytes")),
        Payload_Length=F.when(first, F.col("bytes")),
        Record_Key=F.when(first, F.col("key")),
        Refers_To_Key=F.when(first, F.col("refers")),
    )
    return parts.select(F.concat(F.concat(header, F.lit(BLANK)).cast("binary"), "piece").alias("segment"))


def write(rows: DataFrame, path: str, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", chunk: int = 1 << 18, revisit_from: int = 0) -> None:
    """Archives in ``path``, one gzip WARC file for each partition."""
    out = segments(rows, id_col, uri_col, payload_col, chunk, revisit_from)
    out.select(F.col("segment").cast("string").alias("value")).write.option("lineSep", BLANK).option("compression", "gzip").text(path)


CHUNK = "key string, record_id string, record_type string, uri string, chunk_no int, is_last boolean, payload_bytes long, payload_digest string, refers_to_key string, refers_to_id string, data binary"


class Reader:
    """Follows the bytes of one archive; gives a row for each chunk, and keeps one chunk and one digest state."""

    def __init__(self, with_data: bool):
        self.with_data = with_data
        self.head, self.left, self.fields = b"", 0, None
        self.whole: dict[str, str] = {}  # the header of the record whose chunks are being read
        self.number, self.bytes, self.sha1, self.http = 0, 0, hashlib.sha1(), b""

    def feed(self, data: bytes) -> Iterator[tuple]:
        while data:
            if self.fields is None:
                self.head = (self.head + data).lstrip(b"\r\n")
                head, blank, data = self.head.partition(BLANK.encode())
                if not blank:
                    return
                self.begin(head)
            take, data = data[: self.left], data[self.left :]
            self.part += take
            self.left -= len(take)
            if not self.left:
                yield self.end()

    def begin(self, head: bytes) -> None:
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        self.head, self.part = b"", bytearray()
        self.fields = dict(line.split(": ", 1) for line in lines)
        self.left = int(self.fields["Content-Length"])
        if self.fields["WARC-Type"] == "continuation":
            if self.fields["WARC-Segment-Origin-ID"] != self.whole.get("WARC-Record-ID") or int(self.fields["WARC-Segment-Number"]) != self.number + 1:
                raise ValueError("a segment does not continue the record before it")
        else:
            self.whole, self.number, self.bytes, self.sha1 = self.fields, 0, 0, hashlib.sha1()
            self.http = b"" if self.fields["WARC-Type"] == "response" else None

    def end(self) -> tuple:
        data, whole = bytes(self.part), self.whole
        if self.http is not None:  # the HTTP header, which may itself span chunks
            before, blank, rest = (self.http + data).partition(BLANK.encode())
            self.http, data = (None, rest) if blank else (before, b"")
        self.number += 1
        self.bytes += len(data)
        self.sha1.update(data)
        last = "WARC-Segment-Number" not in self.fields or "WARC-Segment-Total-Length" in self.fields
        said, kind = whole["WARC-Payload-Digest"].removeprefix("sha1:"), whole["WARC-Type"]
        found = base64.b32encode(self.sha1.digest()).decode()
        if kind == "response" and last and found != said:
            raise ValueError(f"{whole['WARC-Record-ID']}: its payload's digest is {found}, not {said}")
        size, found = (self.bytes, found) if kind == "response" else (int(whole["Payload-Length"]), said)
        self.fields = None
        refers = whole.get("WARC-Refers-To")
        return whole.get("Record-Key"), whole["WARC-Record-ID"][1:-1], kind, whole.get("WARC-Target-URI"), self.number, last, size, found, whole.get("Refers-To-Key"), refers and refers[1:-1], data if self.with_data else None


def _read(with_data: bool):
    kinds = [pa.string()] * 4 + [pa.int32(), pa.bool_(), pa.int64()] + [pa.string()] * 3 + [pa.binary()]
    names = [x.split()[0] for x in CHUNK.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, reader, rows, held = None, None, [], 0

        def made() -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            for value, at in zip(batch["value"], batch["path"], strict=True):
                if (at := at.as_py()) != path:
                    path, reader = at, Reader(with_data)
                for row in reader.feed(value.as_py() + BLANK.encode()):
                    rows.append(row)
                    held += len(row[-1] or b"") + 300
                if held > 8 << 20:
                    yield made()
                    rows, held = [], 0
        yield made()

    return run


def read_chunks(spark: SparkSession, path: str, with_data: bool = True) -> DataFrame:
    """A row for each chunk of each record in the archives of ``path``; ``payload_bytes`` and ``payload_digest`` are those of
    the payload up to and including the chunk (of the whole payload for revisits)."""
    pieces = spark.read.schema(T.StructType([T.StructField("value", T.StringType())])).option("lineSep", BLANK).text(path)
    return pieces.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("path")).mapInArrow(_read(with_data), CHUNK)


def round_trip(rows: DataFrame, id_col: str = "page_id", uri_col: str = "url", payload_col: str = "html", chunk: int = 1 << 18, revisit_from: int = 0) -> DataFrame:
    """Write ``rows`` into archives in the shared folder and read them back: a row for each record."""
    path = shared_folder(rows.sparkSession)
    write(rows, path, id_col, uri_col, payload_col, chunk, revisit_from)
    kind = rows.schema[id_col].dataType
    last = read_chunks(rows.sparkSession, path, with_data=False).where("is_last")
    return last.select(F.col("key").cast(kind).alias(id_col), "payload_bytes", "payload_digest", "record_type", F.col("refers_to_key").cast(kind).alias("refers_to"), "record_id", F.col("chunk_no").alias("n_chunks"))
