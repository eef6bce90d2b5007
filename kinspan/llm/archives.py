"""Legacy web archives: ARC files of versions 1 and 2 read and turned into WARC 1.1.

Files are written and read by Spark's own sources (``text`` with a record separator, gzip,
and ``binaryFile``), so that any store that Spark reaches will do.  An archive is as large
as the input split that it was written from; one archive is held by the task that parses it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import cut, fresh_folder

#: The field lists that a version block declares.
ARC_FIELDS = {
    "1": "URL IP-address Archive-date Content-type Archive-length",
    "2": "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 1000
RECORDS_A_FILE = 20_000
#: Bytes of a gzip file that are fed at a time.
PIECE = 1 << 14


def write_arc(
    pages: DataFrame,
    path: str,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    body_col: str = "html",
    date: str = "20240102030405",
) -> None:
    """Pages as gzipped ARC files, one a partition; partitions take versions 1 and 2 in turn.

    Each record is an HTTP response whose body is the page (null: empty); the id travels in an
    ``X-Page-Id`` header (absent where it is null).  Blanks in a URL are percent-encoded, as its
    field ends at a blank; a null URL is written as ``-``.
    """

    def records(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        version = "12"[part % 2]
        block = f"{version} 0 kinspan\n{ARC_FIELDS[version]}\n"
        name = f"part-{part}.arc"
        if version == "1":
            first = f"filedesc://{name} 0.0.0.0 {date} text/plain {len(block) + 1}\n{block}"
        else:
            first = f"filedesc://{name} 0.0.0.0 {date} text/plain 200 - - 0 {name} {len(block) + 1}\n{block}"
        begun, at = False, 0
        for batch in batches:
            out = []
            if not begun:
                out.append(first.encode())
                at, begun = len(first) + 1, True
            for key, url, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                body = body or b""
                head = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                head += "" if key is None else f"X-Page-Id: {key}\r\n"
                content = f"{head}Content-Length: {len(body)}\r\n\r\n".encode() + body
                place = "-" if url is None else re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) or "-"
                if version == "1":
                    line = f"{place} 192.0.2.1 {date} text/html {len(content)}\n"
                else:
                    sum_ = hashlib.sha1(content).hexdigest()
                    line = f"{place} 192.0.2.1 {date} text/html 200 {sum_} - {at} {name} {len(content)}\n"
                out.append(line.encode() + content)
                at += len(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    rows = pages.select(F.col(id_col).cast("long"), F.col(url_col), F.col(body_col).cast("binary"))
    made = rows.mapInArrow(records, "record binary").select(F.col("record").cast("string").alias("value"))
    made.write.option("lineSep", "\n").option("compression", "gzip").text(path)


def inflated(content: bytes) -> tuple[memoryview, str | None]:
    """The bytes of a file, plain or of one or more gzip members, and what is wrong where they end too soon.

    Members are fed in pieces, so that what follows one is not copied once for each member.
    """
    data, at, out = memoryview(content), 0, []
    if content[:2] != b"\x1f\x8b":
        return data, None
    wrong = None
    while wrong is None and bytes(data[at : at + 2]) == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while wrong is None and not member.eof:
            piece = data[at : at + PIECE]
            if not len(piece):
                wrong = "a gzip member ends after its file"
                break
            try:
                out.append(member.decompress(piece))
            except zlib.error as e:
                wrong = f"a gzip member is broken: {e}"
            at += len(piece) - len(member.unused_data)
    if wrong is None and bytes(data[at:]).strip(b"\0"):
        wrong = f"no gzip member at byte {at}"
    return memoryview(b"".join(out)), wrong


def _line(data: memoryview, at: int) -> tuple[str, int]:
    stop = at
    step = 4096
    while stop < len(data):
        found = bytes(data[stop : stop + step]).find(b"\n")
        if found >= 0:
            return bytes(data[at : stop + found]).decode("utf-8", "replace").rstrip("\r"), stop + found + 1
        stop += step
    return bytes(data[at:]).decode("utf-8", "replace"), len(data)


def arc_records(content: bytes) -> Iterator[dict]:
    """The records of an ARC file after its version block, by the fields that the block declares.

    A file whose version block cannot be read is a ``ValueError``; where a record cannot, an ``error`` is the last one.
    """
    data, wrong = inflated(content)
    if not len(data):
        if wrong:
            raise ValueError(wrong)
        return
    line, at = _line(data, 0)
    if not line.startswith("filedesc://"):
        raise ValueError("an ARC file must begin with a filedesc record")
    stop = at + int(line.rsplit(" ", 1)[1])
    version, at = _line(data, at)
    if version.split(" ")[0] not in ARC_FIELDS:
        raise ValueError(f"unknown ARC version {version!r}")
    fields = _line(data, at)[0].split(" ")
    at = stop
    while at < len(data):
        begun = at
        line, at = _line(data, at)
        if not line:
            continue
        # old crawlers left blanks in URLs, so the fields are counted from the right
        values = line.rsplit(" ", len(fields) - 1)
        record = dict(zip(fields, values, strict=False))
        size = record.get("Archive-length", "")
        if not size.isdigit() or at + int(size) > len(data):
            # without a length nothing says where the next record begins
            yield {"offset": begun, "error": f"unreadable from byte {begun} on: {line[:200]}"}
            return
        size = int(size)
        yield record | {"offset": begun, "content": data[at : at + size]}
        at += size
    if wrong:
        yield {"offset": at, "error": wrong}


def split_http(content: memoryview | bytes) -> tuple[bytes, bytes]:
    """An HTTP message's head, with the blank line that ends it, and its body."""
    raw = bytes(content)
    if not raw.startswith(b"HTTP/"):
        return b"", raw
    cut = raw.find(b"\r\n\r\n")
    return (raw[: cut + 4], raw[cut + 4 :]) if cut >= 0 else (raw, b"")


def http_header(head: bytes, name: bytes) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name) + rb":[ \t]*([^\r\n]*)", head)
    return found[1].decode("utf-8", "replace").strip() if found else None


def warc_date(arc_date: str) -> str:
    """``YYYYMMDDhhmmss``, or a shorter form of it, as ISO 8601 in UTC."""
    d = (arc_date + "00000101000000"[len(arc_date) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:]}Z"


def record_urn(*parts: object) -> str:
    """A name that depends on nothing but the record, so that a repeated task gives it again."""
    x = hashlib.sha1("\n".join(map(str, parts)).encode()).hexdigest()
    return f"<urn:uuid:{x[:8]}-{x[8:12]}-5{x[13:16]}-8{x[17:20]}-{x[20:32]}>"


CAPTURE = (
    "record_id string, page_id long, url string, ip string, date string, http_head binary,"
    " payload binary, payload_bytes long, payload_digest string, error string"
)


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all ARC files below a path, with WARC identifiers, timestamps and SHA-1 digests.

    Every file is read, whatever its name.  What cannot be read is a row with nothing but ``url``, the file's
    path, and ``error``; the records before it are captures as others.
    """

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("ip", pa.string()), ("date", pa.string()),
             ("http_head", pa.binary()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string())]
        )

        def records(content: bytes) -> Iterator[dict]:
            try:
                yield from arc_records(content)
            except (ValueError, IndexError) as e:
                yield {"offset": 0, "error": str(e)}

        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held = [], 0
                for r in records(content):
                    if "error" in r:
                        rows.append((None, None, name, None, None, None, None, None, None, r["error"]))
                        continue
                    head, body = split_http(r["content"])
                    key = http_header(head, b"X-Page-Id")
                    digest = hashlib.sha1(body).hexdigest()
                    place = name.rsplit("/", 1)[-1]
                    rows.append((record_urn(place, r["offset"], r["URL"], digest), int(key) if key else None, r["URL"], r["IP-address"],
                                 warc_date(r["Archive-date"]), head, body, len(body), digest, None))
                    held += len(body)
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(parse, CAPTURE)


def convert(captures: DataFrame, path: str, *, work: str, errors: str) -> None:
    """Captures as gzipped WARC files of ``RECORDS_A_FILE`` records at most.

    What could not be read, ``url`` (the archive's path) and ``error``, is a table written to ``errors``.

    Of captures with equal payloads of ``LEAST_REVISIT`` bytes or more, the one with the largest
    page id (and, among equal ids, the largest record id) is a response; the others become
    revisits that name it.  The table of payloads that occur more than once is written to
    ``work`` first: Spark broadcasts it below its own threshold, and else sorts and joins it.
    """
    captures = cut(captures)  # archives are parsed once
    captures.where("error IS NOT NULL").select("url", "error").write.parquet(errors)
    captures = captures.where("error IS NULL").drop("error")
    long = F.col("payload_bytes") >= LEAST_REVISIT
    (
        captures.where(long)
        .select("payload_digest", "payload_bytes", F.struct("page_id", "record_id", "url", "date").alias("one"))
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.max("one").alias("kept"), F.count("*").alias("copies"))
        .where("copies > 1")
        .drop("copies")
        .write.parquet(work)
    )
    many = captures.sparkSession.read.parquet(work)
    rows = captures.join(many, ["payload_digest", "payload_bytes"], "left")
    again = F.col("kept").isNotNull() & (F.col("kept.record_id") != F.col("record_id"))
    head = F.col("http_head").cast("string")
    block = F.when(again, F.octet_length("http_head")).otherwise(F.octet_length("http_head") + F.col("payload_bytes"))
    eol = F.lit("\r\n")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, eol)
    digest = F.concat(F.lit("sha1:"), F.col("payload_digest"))
    refers = F.concat(
        line("WARC-Profile", F.lit(PROFILE)),
        line("WARC-Refers-To", F.col("kept.record_id")),
        line("WARC-Refers-To-Target-URI", F.col("kept.url")),
        line("WARC-Refers-To-Date", F.col("kept.date")),
    )
    record = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Date", F.col("date")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-IP-Address", F.col("ip")),
        line("WARC-Payload-Digest", digest),
        F.when(again, refers).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", block.cast("string")),
        eol,
        head,
        F.when(again, F.lit("")).otherwise(F.col("payload").cast("string")),
    )
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def warc_records(content: bytes) -> Iterator[tuple[dict, bytes]]:
    """Header fields (lower-case names) and block of each record of a WARC file; ``ValueError`` where one cannot be read."""
    data, wrong = inflated(content)
    at = 0
    while at < len(data):
        line, after = _line(data, at)
        if not line:
            at = after
            continue
        if not line.startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        fields: dict[str, str] = {}
        while True:
            line, after = _line(data, after)
            if not line:
                break
            name, _, value = line.partition(":")
            fields[name.strip().lower()] = value.strip()
        size = fields.get("content-length", "")
        if not size.isdigit() or after + int(size) > len(data):
            raise ValueError(f"the WARC record at {at} has no length or ends after its file")
        yield fields, bytes(data[after : after + int(size)])
        at = after + int(size)
    if wrong:
        raise ValueError(wrong)


def _sha1(value: str) -> str | None:
    """A header's SHA-1 digest as lower-case hex; of another algorithm, or malformed, none."""
    algorithm, _, digest = value.partition(":")
    if algorithm.lower() != "sha1":
        return None
    if re.fullmatch("[0-9a-fA-F]{40}", digest):
        return digest.lower()
    return base64.b32decode(digest.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", digest) else None


RECORD = (
    "record_id string, page_id long, url string, date string, record_type string, payload_bytes long,"
    " payload_digest string, refers_to_id string, error string"
)


def _warc_row(fields: dict, block: bytes) -> tuple | None:
    """A response or revisit as a row of ``RECORD``; other records have none."""
    kind = fields.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    head, body = split_http(block)
    told = _sha1(fields.get("warc-payload-digest", ""))
    key = http_header(head, b"X-Page-Id")
    page = int(key) if key and re.fullmatch(r"-?\d{1,18}", key) else None
    if kind == "revisit":
        size, digest, error = None, told, None  # its payload is that of the record it refers to
    else:
        size, digest = len(body), hashlib.sha1(body).hexdigest()
        error = f"the payload does not match its digest {told}" if told not in (None, digest) else None
    return (fields.get("warc-record-id"), page, fields.get("warc-target-uri"), fields.get("warc-date"), kind, size, digest, fields.get("warc-refers-to"), error)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per response or revisit record of all WARC files below a path, with ``error``.

    Digests of responses are computed from the payload; where the header has a SHA-1 digest that differs, ``error`` says
    so, while digests of other algorithms are not compared.  Revisits hold no payload, so ``payload_bytes`` is null for them.  A file that
    cannot be read to its end has one row more, with nothing but ``url``, its path, and ``error``.
    """

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = []
                try:
                    for fields, block in warc_records(content):
                        if (row := _warc_row(fields, block)) is not None:
                            rows.append(row)
                except ValueError as e:
                    rows.append((None, None, name, None, None, None, None, None, str(e)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "content").mapInArrow(parse, RECORD)


def archive_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Pages through legacy ARC files into WARC files and back, a row per page.

    Result: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, warc_date,
    record_id``.  Null pages count as empty payloads; rows with equal ids and equal long payloads
    make one response and revisits of it; a null id reads back as null and sorts below others.
    An empty table gives an empty result; further columns of the input are not archived.
    The archives stay in the shared folder, with a table of what could not be read (``errors``).  A record that this
    same call wrote and cannot read back is an error of the job.
    """
    spark = pages.sparkSession
    at = fresh_folder(spark, "archives")
    write_arc(pages, f"{at}/arc", id_col=id_col, url_col=url_col, body_col=body_col)
    convert(read_arc(spark, f"{at}/arc"), f"{at}/warc", work=f"{at}/copies", errors=f"{at}/errors")
    read_warc(spark, f"{at}/warc").write.parquet(f"{at}/records")
    records = spark.read.schema(RECORD).parquet(f"{at}/records")
    torn = spark.read.parquet(f"{at}/errors").select("error").unionByName(records.where("error IS NOT NULL").select("error")).head(1)
    if torn:
        raise ValueError(f"archives just written cannot be read back: {torn[0][0]}")
    keep = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("date").alias("warc_date"), "record_id"]
    own = records.where("record_type = 'response'")
    target = own.select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), "payload_bytes")
    revisits = records.where("record_type = 'revisit'").drop("payload_bytes").join(target, "refers_to_id", "left")
    return own.withColumn("refers_to", F.lit(None).cast("long")).select(*keep).unionByName(revisits.select(*keep))
