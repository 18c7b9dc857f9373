"""WARC archives of web pages, and segment reassembly when they are read back.

Writing: each page is an HTTP response in chunked transfer framing inside a WARC record. Of pages with equal payloads of
at least `least` bytes the one with the largest page_id is a response record and the others are revisit records that
refer to it. A block longer than `segment` bytes is cut into a first record and continuation records, which carry the
first one's identifier, their number, and at last the total length. Spark's text writer writes the archives: a record's
end, two line ends, is the writer's line separator.

Reading: archives are read once, as whole files, whose size is bounded by the number of records and the size of a segment, and cut into records by their Content-Length. Records that
are not segmented are decoded where they are read. Segments, and only those, are grouped by the origin's identifier by a
shuffle, ordered by segment number, joined, held against the total length, and then the chunked framing is decoded. Revisits
take length and digest from the response that they refer to, and are whole if that one is and has the digest they state.
An archive that ends early or can't be unpacked gives its records up to there, and one row of type 'broken' for the rest.

Null html is an empty payload, null url is left out, a null page_id stays null. Repeated rows make a record each; of
several rows with the same largest page_id and payload one is the response. An empty table gives an empty result. Other
columns don't take part, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .skew import join_hot
from .store import delete, new_path, written

#: A block beyond so many bytes is cut into segments: less than most pages have.
SEGMENT_BYTES = 2 << 10
#: Bytes of payload in an HTTP chunk.
CHUNK_BYTES = 8 << 10
#: Records in an archive file at most: of a segment and its head each, so some 40 MB.
FILE_RECORDS = 16_000
#: Up to so many groups of equal payloads are broadcast (some 100 bytes each); beyond, they are joined by shuffle.
BROADCAST_GROUPS = 50_000

RECORD_END = "\r\n\r\n"


def _pieces(data: bytes, size: int) -> list[bytes]:
    """data in pieces of at most size + 3 bytes, never cut within a UTF-8 character."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + size)
        while end < len(data) and data[end] & 0xC0 == 0x80:
            end += 1
        out.append(data[at:end])
        at = end
    return out


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in _pieces(payload, size)) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload in a body in chunked transfer framing; ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk has not the length it states")
        out.append(body[at : at + n])
        at += n + 2


def _head(fields: list[tuple[str, str | None]], length: int) -> str:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields if v is not None), f"Content-Length: {length}"]
    return "\r\n".join(lines) + "\r\n\r\n"


def records(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, record_id: int, refers_to: int | None, refers_record: int | None, segment: int = SEGMENT_BYTES) -> Iterator[str]:
    """Text of a page's WARC records, without the end of record."""
    ident = f"<urn:record:{record_id}>"
    where = None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields = [("WARC-Record-ID", ident), ("WARC-Date", "2000-01-01T00:00:00Z"), ("WARC-Target-URI", where), ("Page-ID", None if page_id is None else str(page_id)), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if payload is None:
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
        yield _head([("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:record:{refers_record}>"), ("Refers-To-Page-ID", None if refers_to is None else str(refers_to)), *fields], len(block)) + block
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield _head([("WARC-Type", "response"), *fields], len(block)) + block.decode("utf-8")
        return
    parts = _pieces(block, segment)
    for i, part in enumerate(parts, 1):
        last = ("WARC-Segment-Total-Length", str(len(block)) if i == len(parts) else None)
        own = [("WARC-Type", "response"), *fields] if i == 1 else [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:record:{record_id}:{i}>"), ("WARC-Segment-Origin-ID", ident), ("WARC-Date", "2000-01-01T00:00:00Z"), last]
        yield _head([*own, ("WARC-Segment-Number", str(i))], len(part)) + part.decode("utf-8")


def parsed(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields with lower-case names, block) of each record of an archive."""
    at = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        first, *lines = archive[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record begins at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields["content-length"])
        yield fields, archive[end + 4 : end + 4 + n]
        at = end + 4 + n + len(RECORD_END)


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, segment: int = SEGMENT_BYTES) -> None:
    """Archives of all pages, as gzip files below path."""
    base = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    # Written once, so that a record keeps its number whatever is computed again; not needed when the archives are there.
    numbered = new_path(pages.sparkSession, "numbered-pages")
    base = written(base.withColumn("record", F.monotonically_increasing_id()).withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("size", F.octet_length("html").cast("long")), "numbered-pages", numbered)
    largest = base.filter(F.col("size") >= least).groupBy("digest", "size").agg(F.max(F.struct(F.coalesce("page_id", F.lit(-(1 << 63))), "page_id", "record")).alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    largest = written(largest.select(F.col("digest").alias("same"), F.col("size").alias("same_size"), F.col("m.page_id").alias("refers_to"), F.col("m.record").alias("refers_record")), "equal-payloads")
    small = F.broadcast(largest) if largest.count() <= BROADCAST_GROUPS else largest
    key = F.when(F.col("size") >= least, F.col("digest")).otherwise(F.concat(F.lit("small "), F.col("record").cast("string")))  # short payloads are dealt evenly
    joined = base.withColumn("key", key).join(small, (F.col("key") == F.col("same")) & (F.col("size") == F.col("same_size")), "left")
    again = F.col("same").isNotNull() & (F.col("record") != F.col("refers_record"))
    rows = joined.select("page_id", "url", F.when(~again, F.col("html")).alias("html"), "size", "digest", "record", F.when(again, F.col("refers_to")).alias("refers_to"), F.when(again, F.col("refers_record")).alias("refers_record"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = lambda x: None if pd.isna(x) else int(x)
        for frame in frames:
            for lo in range(0, len(frame), 500):
                out: list[str] = []
                for r in frame.iloc[lo : lo + 500].itertuples(index=False):
                    out += records(whole(r.page_id), r.url, None if r.html is None else r.html.encode("utf-8"), int(r.size), r.digest, int(r.record), whole(r.refers_to), whole(r.refers_record), segment)
                yield pd.DataFrame({"value": out})

    rows = rows.select(*[F.col(c).cast("string").alias(c) if c in ("page_id", "refers_to", "refers_record") else F.col(c) for c in rows.columns])
    rows.mapInPandas(run, "value string").write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)
    delete(pages.sparkSession, numbered)


_ROW = "page_id long, record_type string, stated_digest string, refers_to long, payload_bytes long, payload_digest string, whole boolean, record string, refers_record string"
_NUMBERS = ("page_id", "refers_to", "payload_bytes")
_SEGMENT = ["origin", "number", "total", "fields", "block"]


def unpacked(content: bytes) -> tuple[bytes, bool]:
    """What a gzip file holds as far as it can be unpacked, and whether that is all."""
    out = []
    while content:
        part = zlib.decompressobj(zlib.MAX_WBITS | 16)
        try:
            out.append(part.decompress(content))
        except zlib.error:
            return b"".join(out), False
        if not part.eof:
            return b"".join(out), False
        content = part.unused_data
    return b"".join(out), True


def _decoded(fields: dict[str, str], block: bytes) -> tuple:
    number = lambda k: int(fields[k]) if k in fields else None
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    head, _, body = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    if fields["warc-type"] == "revisit":
        return number("page-id"), "revisit", stated, number("refers-to-page-id"), None, None, True, fields.get("warc-record-id"), fields.get("warc-refers-to")
    payload = dechunked(body) if http.get("transfer-encoding", "").lower() == "chunked" else body
    digest = hashlib.sha1(payload).hexdigest()
    return number("page-id"), fields["warc-type"], stated, None, len(payload), digest, digest == stated, fields.get("warc-record-id"), None


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and `whole` (total length and digest as stated, of revisits by the record they refer to) of every record."""
    names = [x.split(" ")[0] for x in _ROW.split(", ")]
    segments = "origin string, number int, total long, fields string, block binary"

    def found(content: bytes) -> Iterator[tuple[dict[str, str], bytes] | None]:
        """Records of an archive, and None for what can't be read of it."""
        data, ended = unpacked(content)
        try:
            for fields, block in parsed(data):
                if len(block) < int(fields["content-length"]):
                    ended = False
                else:
                    yield fields, block
        except (ValueError, KeyError):
            ended = False
        if not ended:
            yield None

    def alone(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                out = []
                for record in found(content):
                    if record is None:
                        out.append((None, "broken", None, None, None, None, False, None, None))
                    elif "warc-segment-number" not in record[0]:
                        fields = record[0]
                        try:
                            out.append(_decoded(*record))
                        except ValueError:  # broken chunked framing: the record is told, but not whole
                            out.append((int(fields["page-id"]) if "page-id" in fields else None, fields.get("warc-type"), None, None, None, None, False, fields.get("warc-record-id"), None))
                yield pd.DataFrame(out, columns=names).astype({k: "Int64" for k in _NUMBERS})

    def segment(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for frame in frames:
            for content in frame["content"]:
                out = []
                for fields, block in filter(None, found(content)):
                    if "warc-segment-number" in fields:
                        total, number = fields.get("warc-segment-total-length"), int(fields["warc-segment-number"])
                        out.append((fields.get("warc-segment-origin-id", fields["warc-record-id"]), number, None if total is None else int(total), json.dumps(fields) if number == 1 else None, block))
                    if len(out) == 1000:
                        yield pd.DataFrame(out, columns=_SEGMENT).astype({"number": "Int64", "total": "Int64"})
                        out = []
                if out:
                    yield pd.DataFrame(out, columns=_SEGMENT).astype({"number": "Int64", "total": "Int64"})

    def second(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                block = b"".join(bytes(x) for x in r.blocks)
                complete = list(r.numbers) == list(range(1, len(r.numbers) + 1)) and not pd.isna(r.total) and int(r.total) == len(block)
                try:
                    row = _decoded(json.loads(r.fields), block)
                except (ValueError, TypeError):
                    fields = json.loads(r.fields) if r.fields else {}
                    page, stated = fields.get("page-id"), fields.get("warc-payload-digest", "").removeprefix("sha1:")
                    row = (None if page is None else int(page), fields.get("warc-type"), stated, None, None, None, False, fields.get("warc-record-id"), None)
                out.append((*row[:6], bool(row[6] and complete), *row[7:]))
            yield pd.DataFrame(out, columns=names).astype({k: "Int64" for k in _NUMBERS})

    archives = spark.read.format("binaryFile").load(path).select("content")
    each = F.sort_array(F.collect_list(F.struct("number", "block")))  # a record's own segments only
    grouped = archives.mapInPandas(segment, segments).groupBy("origin").agg(each.alias("s"), F.max("total").alias("total"), F.max("fields").alias("fields"))
    joined = written(grouped.select(F.col("s.number").alias("numbers"), F.col("s.block").alias("blocks"), "total", "fields").mapInPandas(second, _ROW), "joined-records")
    rows = written(archives.mapInPandas(alone, _ROW), "records").unionByName(joined)
    # Only records that are referred to are looked up; one may be referred to by very many.
    again = rows.filter("record_type = 'revisit'")
    of = rows.filter("record_type = 'response'").select(F.col("record").alias("refers_record"), F.col("payload_bytes").alias("__bytes"), F.col("payload_digest").alias("__digest"), F.col("whole").alias("__whole"))
    told = join_hot(again, of, "refers_record", "left").select("page_id", F.col("__bytes").alias("payload_bytes"), F.col("__digest").alias("payload_digest"), "record_type", "refers_to", F.coalesce(F.col("__whole") & (F.col("__digest") == F.col("stated_digest")), F.lit(False)).alias("whole"))
    return rows.filter("record_type <> 'revisit' or record_type is null").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole").unionByName(told)


def pages_through_warc(pages: DataFrame, **how) -> DataFrame:
    """pages written as archives in the shared folder and read back."""
    path = new_path(pages.sparkSession, "warc")
    write_archives(pages, path, **how)
    return read_archives(pages.sparkSession, path)
