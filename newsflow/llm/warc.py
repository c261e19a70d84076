r"""WARC archives: writing, and reading back by boundary-chain verification.

Writing. A record is a header, a blank line and the payload, and ends with two line breaks. Spark's text writer
writes just that, with the two line breaks as its line separator. Of records with equal payloads the one with the
smallest page_id is a response; the others are revisits that name it and carry no payload. Payloads shorter than
``least_bytes`` are always responses.

Reading. A payload may hold the very line that starts a record, so a start line proves nothing. Tasks cut archives at
every start line and emit, for each, a candidate: its offset and, if a header follows, the offset of its successor
by the header's content length. The file start is a record; by pointer jumping (after round k, records reachable
in fewer than 2^k steps are known and every pointer spans 2^k steps) the records reachable from it are found, in
as many rounds as the logarithm of a file's records. All others are text inside a payload.

Archives are gzip files of at most ``FILE_RECORDS`` records, each read by one task as a stream; a task holds the runs of
bytes of open candidates' payloads only as long as they may still end.

A null html is an empty payload; a null url is left out of the header, a page without an id is named by its digest, and both
are read back as null, as is the page_id of a record with a foreign id, whose own is in ``record_id``. Headers that are no
headers, or that hold no numbers where numbers belong, end no job. An empty table gives archives without records. Equal pages
(ids repeated) give several records; the smallest id's are then all responses. Line breaks in a url are escaped.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsflow.llm.common import staged
from newsflow.operators.joins import join_group_totals
from newsflow.sources.session import fresh_dir

MAGIC = "WARC/1.0\r\n"
RECORD_END = "\r\n\r\n"
LEAST_BYTES = 0
FILE_RECORDS = 20_000
HEX_TO_BASE32 = ("0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
IDENTICAL = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE = "<urn:page:"
CANDIDATES = (
    "file string, at long, next long, record_type string, record_id string, page_id string, refers_to string, url string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def sha1_base32(data: Column) -> Column:
    """The SHA-1 digest as 32 base32 digits: 5 hexadecimal digits are 4 of these."""
    digest = F.sha1(data)
    quarters = [
        F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)
    ]
    return F.translate(F.concat(*quarters), *HEX_TO_BASE32)


def _header(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def plan_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes and ``first_id``, the id of the response a page revisits or null."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        "page_id",
        "url",
        html.alias("html"),
        sha1_base32(html.cast("binary")).alias("payload_digest"),
        F.octet_length(html).cast("long").alias("payload_bytes"),
    )
    groups = rows.groupBy("payload_digest").agg(F.min("page_id").alias("smallest"), F.count("*").alias("copies"))
    joined = join_group_totals(rows, groups, ["payload_digest"], "copies", spread=F.col("page_id"))
    revisits = (F.col("payload_bytes") >= least_bytes) & (F.col("page_id") != F.col("smallest"))
    return joined.withColumn("first_id", F.when(revisits, F.col("smallest"))).drop("smallest", "copies")


def write_archives(records: DataFrame, path: str, date: Column | None = None) -> None:
    """One record per row into gzip archives below ``path``. ``date`` is a timestamp, by default the time of writing."""
    revisit = F.col("first_id").isNotNull()
    written = F.current_timestamp() if date is None else date
    own_id = F.concat(F.lit(PAGE), F.col("page_id").cast("string"), F.lit(">"))
    # A page without an id is named by its content; the header must not lack a record id.
    named = F.coalesce(own_id, F.concat(F.lit("<urn:sha1:"), F.col("payload_digest"), F.lit(">")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        F.lit(MAGIC),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", named),
        _header("WARC-Date", F.date_format(F.to_utc_timestamp(written, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        _header("WARC-Refers-To", F.concat(F.lit(PAGE), F.col("first_id").cast("string"), F.lit(">"))),
        _header("WARC-Profile", F.when(revisit, F.lit(IDENTICAL))),
        _header("WARC-Target-URI", url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        _header("X-Payload-Length", F.col("payload_bytes")),
        _header("Content-Length", F.when(revisit, F.lit(0).cast("long")).otherwise(F.col("payload_bytes"))),
        F.lit("\r\n"),
        F.when(revisit, F.lit("")).otherwise(F.col("html")),
    )
    writer = records.select(record.alias("value")).write.option("lineSep", RECORD_END)
    writer.option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _count(text: str) -> int:
    """A number of bytes; -1 for other text."""
    return int(text) if text.isascii() and text.isdigit() and len(text) < 19 else -1


class Candidate:
    """A start line with a header; collects its payload from the stream until the content length is reached."""

    def __init__(self, file: str, at: int, head: bytes, body_at: int) -> None:
        self.fields = {}
        for line in head.split(b"\r\n"):
            name, colon, value = line.partition(b": ")
            if colon:
                self.fields[name.decode("utf-8", "replace").lower()] = value.decode("utf-8", "replace")
        self.file, self.at = file, at
        self.length = _count(self.fields.get("content-length", ""))
        self.next = body_at + self.length + len(RECORD_END)
        self.digest, self.left = hashlib.sha1(), self.length
        self.body: list[bytes] = []

    def feed(self, data: bytes, keep: bool) -> None:
        part = data[: self.left]
        self.digest.update(part)
        if keep:
            self.body.append(part)
        self.left -= len(part)

    def row(self) -> tuple:
        """The candidate as a row. Its header may be any text of a page, so nothing in it is taken to be well formed."""

        def page(name: str) -> str | None:
            value = self.fields.get(name, "")
            return value[len(PAGE) : -1] if value.startswith(PAGE) and value.endswith(">") else None

        digest = base64.b32encode(self.digest.digest()).decode()
        size, kind = self.length, self.fields.get("warc-type")
        if kind == "revisit":  # the payload is the response's; the header tells of it
            digest = self.fields.get("warc-payload-digest", "").removeprefix("sha1:")
            size = _count(self.fields.get("x-payload-length", ""))
        ids = self.fields.get("warc-record-id"), page("warc-record-id"), page("warc-refers-to")
        return self.file, self.at, self.next, kind, *ids, self.fields.get("warc-target-uri"), size, digest, b"".join(self.body)


def find_candidates(batches: Iterator[pa.RecordBatch], keep: bool) -> Iterator[pa.RecordBatch]:
    """Candidates of archives that come as runs of bytes between start lines, file by file and in order."""
    names = [part.split()[0] for part in CANDIDATES.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, types[part.split()[1]]) for n, part in zip(names, CANDIDATES.split(", "), strict=True)])
    file, offset, start = None, 0, b""
    open_now: list[Candidate] = []
    for batch in batches:
        done: list[tuple] = []
        for name, run in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if name != file:
                file, offset, start, open_now = name, 0, b"", []
            # ``run`` stands at ``offset`` and follows a start line, but for the first run of a file.
            for candidate in open_now:
                candidate.feed(start + run, keep)
            if start:
                head, end, body = run.partition(RECORD_END.encode())
                if end:
                    at = offset - len(start)
                    made = Candidate(file, at, head, offset + len(head) + len(end))
                    if made.length >= 0:
                        made.feed(body, keep)
                        open_now.append(made)
            done += [c.row() for c in open_now if not c.left]
            open_now = [c for c in open_now if c.left]
            start = MAGIC.encode()
            offset += len(run) + len(start)
        yield pa.RecordBatch.from_arrays(
            [pa.array(column, f.type) for column, f in zip(zip(*done, strict=True) if done else [[]] * len(schema), schema, strict=True)],
            schema=schema,
        )


def reachable(pointers: DataFrame) -> DataFrame:
    """(file, at) of the candidates on the chain from each file's start, by pointer jumping over (file, at, next)."""
    jumps = staged(pointers.select("file", "at", "next"), "warc-jumps")
    reached = staged(jumps.filter("at = 0").select("file", "at"), "warc-reached")
    known = reached.count()
    while True:
        further = reached.join(jumps, ["file", "at"]).select("file", F.col("next").alias("at"))
        # Only candidates can be reached; what lies past a file's last record is none.
        new = further.join(pointers.select("file", "at"), ["file", "at"], "left_semi")
        reached = staged(reached.unionByName(new).distinct(), "warc-reached")
        if (count := reached.count()) == known:
            return reached
        known = count
        there = jumps.select("file", F.col("at").alias("next"), F.col("next").alias("beyond"))
        jumps = staged(jumps.join(there, ["file", "next"]).select("file", "at", F.col("beyond").alias("next")), "warc-jumps")


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The true records of all archives below ``path``."""
    runs = spark.read.option("lineSep", MAGIC).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("run")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return find_candidates(batches, keep_payload)

    found = staged(runs.mapInArrow(run, CANDIDATES), "warc-candidates")
    return found.join(reachable(found), ["file", "at"]).withColumns(
        {"page_id": F.col("page_id").try_cast("long"), "refers_to": F.col("refers_to").try_cast("long")}
    )


def archive_report(pages: DataFrame) -> DataFrame:
    """Write the pages, read them back, and tell of each record: page_id, its payload's size and digest, type, response."""
    spark = pages.sparkSession
    path = fresh_dir(spark, "warc")
    write_archives(plan_records(pages), path)
    return read_archives(spark, path, keep_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
