"""WARC archives from legacy ARC archives.

An ARC archive is a version block and records of a space-separated header line and as many bytes as it declares:
version 1 has `URL IP date type length`, version 2 has `URL IP date type code checksum location offset file length`.
Legacy header lines are messy: URLs and types may hold spaces, dates may be short, and bytes need not be UTF-8; a line
is read from its fixed fields (address, date, numbers at the end), and odd bytes are percent-encoded.
The converter synthesises WARC record identifiers (UUID of the URL, date, digest and key), ISO timestamps, types and
digests.  Records with equal payloads of at least REVISIT_BYTES become revisits of the one with the least key, which
name that record, its URL and its date.

Only the payload of a response travels, and equal payloads are combined in the task that reads them, so a page that a
third of all rows share reaches a reducer once a task; revisits are found by joining rows without payloads.

Archives are gzip files of one member a record (a record of 8 MB or more has several), each beginning with a warcinfo
record.  Spark's own writer writes them, so they land whole and committed on any file system that Spark reaches: a
member's last byte, the highest of its length and therefore zero, is the writer's line separator.  They are read back
member by member, by declared lengths.

Null payloads are empty and null URLs are `urn:none`; a null key sorts first; of rows with one key and equal payloads
one is the response and the others revisit it; empty tables give empty archives; extra columns are ignored.
"""

from __future__ import annotations

import datetime
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as c

FILE_BYTES = 64 << 20  # of a file, which is written and read as a whole
REVISIT_BYTES = 100
MEMBER_BYTES = 8 << 20  # of a record in one gzip member
VERSION_1 = "URL IP-address Archive-date Content-type Archive-length"
VERSION_2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
LINE = re.compile(rb"(?P<url>.*?) +(?P<ip>[0-9]{1,3}(?:\.[0-9]{1,3}){3}|[0-9A-Fa-f:]*:[0-9A-Fa-f:.]+|-) +(?P<date>[0-9]{4,17}) +(?P<rest>.*)", re.S)


def arc_date(seconds: int) -> str:
    return (datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=seconds)).strftime("%Y%m%d%H%M%S")


def iso_date(date: str) -> str:
    """An ARC date as an ISO timestamp; digits that lack are those of the year's beginning, impossible ones too."""
    digits = re.sub(r"\D", "", date)[:14]
    try:
        at = datetime.datetime.strptime(digits + "00000101000000"[len(digits) :], "%Y%m%d%H%M%S")
    except ValueError:
        at = datetime.datetime(int(digits[:4]) if digits[:4].isdigit() and 1 <= int(digits[:4]) else 1970, 1, 1)
    return at.isoformat() + "Z"


def clean(raw: bytes) -> str:
    """A header field as text: white space, control characters and bytes that are not UTF-8 percent-encoded."""
    text = raw.decode("utf-8", "surrogateescape")
    return re.sub("[\x00-\x20\x7f\udc80-\udcff]", lambda m: f"%{ord(m[0]) & 0xFF:02X}", text)


def write_arc(records, version: int = 1) -> bytes:
    """An ARC archive of (url, ip, 14-digit date, type, payload)."""
    fields = VERSION_1 if version == 1 else VERSION_2
    intro = f"{version} 0 candlewright\n{fields}\n".encode()
    head = f"filedesc://archive.arc 0.0.0.0 {records[0][2] if records else '19960101000000'} text/plain"
    out = [f"{head} {len(intro)}\n".encode() if version == 1 else f"{head} 200 - - 0 archive.arc {len(intro)}\n".encode(), intro, b"\n"]
    at = sum(map(len, out))
    for url, ip, date, kind, payload in records:
        url = re.sub(r"\s", "%20", url)
        line = f"{url} {ip} {date} {kind} {len(payload)}\n" if version == 1 else f"{url} {ip} {date} {kind} 200 {hashlib.md5(payload).hexdigest()} - {at} archive.arc {len(payload)}\n"
        out += [line.encode(), payload, b"\n"]
        at += len(line.encode()) + len(payload) + 1
    return b"".join(out)


def read_arc(data: bytes):
    """(url, ip, date, type, payload) of an ARC archive of either version, by declared lengths."""
    at, after_type = 0, 1  # fields after the type
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].rstrip(b"\r")
        head = LINE.fullmatch(line)
        tail = head and head["rest"].rsplit(b" ", after_type)
        if line.startswith(b"filedesc:"):
            tail = line.split(b" ")[-1:]
        if not tail or not tail[-1].isdigit() or (head and len(tail) != after_type + 1 and not line.startswith(b"filedesc:")):
            raise ValueError(f"no header line at {at}: {line[:200]!r}")
        length = int(tail[-1])
        body = data[end + 1 : end + 1 + length]
        if len(body) < length:
            raise ValueError(f"record at {at} declares {length} bytes, {len(body)} are left")
        if line.startswith(b"filedesc:"):
            after_type = 6 if body.lstrip()[:1] == b"2" else 1
        else:
            yield clean(head["url"]), head["ip"].decode(), head["date"].decode(), " ".join(tail[0].decode("latin-1").split()) or "application/octet-stream", body
        at = end + 1 + length


def record_name(key, url: str, date: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {date} {digest} {key}')}>"


def warc_record(key, url: str, ip: str, date: str, kind: str, digest: str, length: int, payload: bytes | None, first=None) -> bytes:
    """A WARC/1.1 response, or a revisit of first: (key, url, date)."""
    lines = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_name(key, url, date, digest)}", f"WARC-Date: {iso_date(date)}", f"WARC-Target-URI: {url}", f"WARC-IP-Address: {ip}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Key: {'' if key is None else key}", f"X-Payload-Length: {length}"]
    if first is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_name(first[0], first[1], first[2], digest)}", f"WARC-Refers-To-Target-URI: {first[1]}", f"WARC-Refers-To-Date: {iso_date(first[2])}", f"X-Refers-To-Key: {'' if first[0] is None else first[0]}"]
        payload = b""
    lines += [f"Content-Type: {kind}", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def info_record(number: int) -> bytes:
    body = b"software: candlewright\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"warcinfo {number}")
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: 1996-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """A record as gzip members; the last byte of the last one is zero."""
    return b"".join(gzip.compress(record[at : at + MEMBER_BYTES], 4, mtime=0) for at in range(0, len(record), MEMBER_BYTES))


def read_warc(chunks):
    """(header dict, payload) of the records of WARC data that comes in chunks, by declared lengths."""
    data, at, done = b"", 0, False  # what has been read and where the next record begins in it
    chunks = iter(chunks)

    def more(n: int) -> bool:
        """Whether n bytes from the record's beginning are there."""
        nonlocal data, at, done
        if len(data) - at < n and not done:
            parts, size = [data[at:]], len(data) - at
            while size < n and not done:
                part = next(chunks, None)
                done = part is None
                if part:
                    parts.append(part)
                    size += len(part)
            data, at = b"".join(parts), 0
        return len(data) - at >= n

    while more(1):
        end = data.find(b"\r\n\r\n", at) - at
        while end < 0:
            if not more(len(data) - at + 1):
                raise ValueError("a record's header does not end")
            end = data.find(b"\r\n\r\n", at) - at
        lines = data[at : at + end].decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"no record where one should begin: {lines[0][:100]!r}")
        header = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        to = end + 4 + int(header["Content-Length"])
        if not more(to + 4) or data[at + to : at + to + 4] != b"\r\n\r\n":
            raise ValueError(f"record {header.get('WARC-Record-ID')} does not end at its declared length")
        yield header, data[at + end + 4 : at + to]
        at += to + 4


def inflated(data: bytes, step: int = 1 << 20, feed: int = 1 << 16):
    """The content of concatenated gzip members, a bounded part at a time."""
    at = 0
    while at < len(data):
        unzip = zlib.decompressobj(31)
        while not unzip.eof:
            part = unzip.unconsumed_tail
            if not part:
                part = data[at : at + feed]
                at += len(part)
                if not part:
                    raise ValueError("a gzip member does not end")
            out = unzip.decompress(part, step)
            if out:
                yield out
        at -= len(unzip.unused_data)


def to_arc(pages: DataFrame, key_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(keys: array of keys, arc: an ARC archive) of about a megabyte each; versions alternate."""
    slim = c.columns(pages, id=key_col, url=url_col, text=html_col)

    def task(batches):
        turn = 0
        for batch in batches:
            ids, urls, texts = batch.column("id").to_pylist(), batch.column("url").to_pylist(), batch.column("text").to_pylist()
            at = 0
            while at < len(ids):
                records, keys, size = [], [], 0
                while at < len(ids) and (size < c.BLOCK_BYTES or not keys):
                    payload = (texts[at] or "").encode()
                    records.append((urls[at] or "urn:none", "192.0.2.1", arc_date(820454400 + (ids[at] or 0) % 10**9), "text/html", payload))
                    keys.append(ids[at])
                    size += len(payload)
                    at += 1
                turn += 1
                yield pa.record_batch([pa.array([keys], pa.list_(pa.int64())), pa.array([write_arc(records, 1 + turn % 2)], pa.binary())], ["keys", "arc"])

    return slim.mapInArrow(task, "keys array<bigint>, arc binary")


def convert(arcs: DataFrame) -> DataFrame:
    """(key, record: gzip members) of the records of ARC archives (keys, arc)."""
    c.prepare(arcs.sparkSession)
    fields = "key long, url string, ip string, date string, kind string"

    def parse(batches):
        for batch in batches:
            for keys, arc in zip(batch.column("keys"), batch.column("arc")):
                rows = list(zip(keys.as_py(), read_arc(arc.as_py())))
                for at in range(0, len(rows), 500):
                    part = rows[at : at + 500]
                    yield pa.record_batch([pa.array([k for k, _ in part], pa.int64()), *(pa.array([r[i] for _, r in part]) for i in range(4)), pa.array([r[4] for _, r in part], pa.binary())], ["key", "url", "ip", "date", "kind", "payload"])

    parsed = arcs.mapInArrow(parse, f"{fields}, payload binary").withColumn("rid", F.monotonically_increasing_id())
    parsed = parsed.withColumn("digest", F.sha2("payload", 256)).withColumn("length", F.length("payload").cast("long"))
    large, none = F.col("length") >= REVISIT_BYTES, F.lit(None)
    place = F.struct("key", "url", "rid").alias("place")
    group = F.when(large, F.col("digest")).otherwise(F.concat_ws("-", "digest", "rid"))  # small payloads are responses, each
    response = parsed.groupBy(group.alias("same")).agg(F.min_by(F.struct("key", "url", "ip", "date", "kind", "digest", "length", "payload"), place).alias("r")).select("r.*")
    rows = c.materialise(parsed.where(large).select("key", "url", "ip", "date", "kind", "digest", "length", place), "warc-rows")  # without payloads
    first = rows.groupBy("digest").agg(F.min(F.struct("place", "date")).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    again = rows.join(first.hint("merge"), "digest").where("place <> first.place")
    named = F.struct(F.col("first.place.key").alias("key"), F.col("first.place.url").alias("url"), F.col("first.date").alias("date"))
    some = ["key", "url", "ip", "date", "kind", "digest", "length"]
    whole = response.select(*some, "payload", none.cast("struct<key:bigint,url:string,date:string>").alias("first"))
    every = whole.unionByName(again.select(*some, none.cast("binary").alias("payload"), named.alias("first")))

    def synthesise(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rows = batch.slice(at, 500).to_pylist()
                made = [member(warc_record(*(r[x] for x in some), r["payload"], tuple(r["first"].values()) if r["first"] else None)) for r in rows]
                yield pa.record_batch([pa.array([r["key"] for r in rows], pa.int64()), pa.array(made, pa.binary())], ["key", "record"])

    return every.mapInArrow(synthesise, "key long, record binary")


def write_archives(records: DataFrame, path: str, most: int = 100_000, most_bytes: int = FILE_BYTES) -> None:
    """WARC files of up to `most` records and `most_bytes` (a larger record is one by itself), each with a warcinfo record
    before them.

    Tasks join records to whole files, and the writer puts each in a file of its own; a file's last byte is the writer's
    line separator.
    """

    def files(batches):
        held, size, number = [], 0, 0

        def whole():
            data = b"".join([member(info_record(number)), *held])
            return pa.record_batch([pa.array([data[:-1]], pa.binary())], ["value"])

        for batch in batches:
            for record in batch.column("record"):
                record = record.as_py()
                if held and (len(held) >= most or size + len(record) > most_bytes):
                    yield whole()
                    held, size, number = [], 0, number + 1
                held.append(record)
                size += len(record)
        if held:
            yield whole()

    whole = records.select("record").mapInArrow(files, "value binary")
    whole.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(key, url, record_id, date, payload_bytes, payload_digest, record_type, refers_to, payload: null in revisits)."""

    def task(batches):
        for batch in batches:
            for data in batch.column("content"):
                held, size = [], 0

                def out():
                    text = lambda f, t=pa.string(): pa.array([f(h) for h, _ in held], t)
                    number = lambda x: int(x) if x else None
                    return pa.record_batch(
                        [text(lambda h: number(h["X-Key"]), pa.int64()), text(lambda h: h["WARC-Target-URI"]), text(lambda h: h["WARC-Record-ID"]), text(lambda h: h["WARC-Date"]), text(lambda h: int(h["X-Payload-Length"]), pa.int64()), text(lambda h: h["WARC-Payload-Digest"].removeprefix("sha256:")), text(lambda h: h["WARC-Type"]), text(lambda h: number(h.get("X-Refers-To-Key")), pa.int64()), pa.array([p if h["WARC-Type"] == "response" else None for h, p in held], pa.binary())],
                        ["key", "url", "record_id", "date", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
                    )

                for header, payload in read_warc(inflated(data.as_py())):
                    if header["WARC-Type"] == "warcinfo":
                        continue
                    held.append((header, payload))
                    size += len(payload) + 500
                    if size > c.BLOCK_BYTES * 4:
                        yield out()
                        held, size = [], 0
                if held:
                    yield out()

    schema = "key long, url string, record_id string, date string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(task, schema)
