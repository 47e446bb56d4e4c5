"""WARC archives: written with segmented records, read back and reassembled.

Writing: a page is a ``response`` whose block is an HTTP message in chunked
transfer framing, or, if a page with a smaller id has the same payload, a
``revisit`` of it. A block longer than a segment goes into one record and its
continuations. Each record is a gzip member of its own, so an archive can be
entered at any record. Archives are laid down by Spark's text sink, whose line
separator is a gzip member without content, and can be on any file system that
Spark writes to. A record is no longer than a segment, and an archive has a
bounded number of records, so no file is too large to be read by one task.

Reading: records are cut out of the archives as these are inflated, piece by
piece; those of one origin are brought together, ordered by segment number,
checked against the total length, and the transfer framing is taken off.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path, prepare

_SEGMENT = 32 << 10
_FRAME = 8 << 10
_DATE = "2024-01-01T00:00:00Z"
_RECORDS = 4096  # of an archive
_INFLATE = 1 << 20  # compressed bytes taken at once


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def chunked(data: bytes, frame: int = _FRAME) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(data[i : i + frame]), data[i : i + frame]) for i in range(0, len(data), frame)]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    """Takes chunked framing off; ValueError if it is not whole."""
    out, at = [], 0
    while True:
        eol = data.index(b"\r\n", at)
        size = int(data[at:eol].split(b";")[0], 16)
        at = eol + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk does not end where its size says")
        out.append(data[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """``data`` as a gzip member, without a time, so that equal data are equal bytes."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _line(text: str | None) -> str:
    """A url as a header value: no line ends."""
    return "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "")


def records(origin: str, page: int | None, url: str | None, payload: bytes, refers_to: int | None, segment: int = _SEGMENT) -> Iterator[bytes]:
    own = f"<urn:page:{origin}>"
    own_digest = "sha1:" + digest(payload)
    common = [("WARC-Date", _DATE), ("WARC-Target-URI", _line(url)), ("X-Page-Id", page)]
    if refers_to is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _record([("WARC-Type", "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Profile", profile), ("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("X-Refers-To-Page-Id", refers_to), ("WARC-Payload-Digest", own_digest)], block)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    first = [("WARC-Type", "response"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", own_digest)]
    if len(parts) == 1:
        yield _record(first, block)
        return
    yield _record([*first, ("WARC-Segment-Number", 1)], parts[0])
    for k, part in enumerate(parts[1:], 2):
        total = len(block) if k == len(parts) else None
        yield _record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{origin}:{k}>"), *common, ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], part)


def _write(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            out: list[bytes] = []
            for page, url, html, refers in zip(*(c.to_pylist() for c in batch.slice(lo, 512).columns), strict=True):
                row += 1
                out.extend(map(member, records(f"{part}-{row}", page, url, html, refers, segment)))
            yield pa.RecordBatch.from_pydict({"record": out})


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, segment: int = _SEGMENT) -> None:
    """Archives of ``pages`` under ``path``.

    Payload: the html in UTF-8, null as empty. Of equal payloads of at least
    ``least_bytes`` the smallest id is the response, the others revisit it; rows
    that repeat the smallest id are all responses, and so are rows without id.
    """
    prepare(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), payload.alias("payload"))
    marks = rows.where(F.octet_length("payload") >= least_bytes).select("page", F.unhex(F.sha1("payload")).alias("sha"))
    first = marks.groupBy("sha").agg(F.min("page").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    again = marks.join(first, "sha").where("page <> refers_to").groupBy("page", "sha").agg(F.min("refers_to").alias("refers_to"))
    # A table of its own, so that its size is known: a small one is broadcast and payloads stay where they are.
    again = cut(again.select(F.col("page").alias("p"), F.col("sha").alias("s"), "refers_to"), "revisits")
    told = rows.join(again, (F.col("page") == F.col("p")) & (F.unhex(F.sha1("payload")) == F.col("s")), "left")
    out = told.select("page", "url", "payload", "refers_to").mapInArrow(partial(_write, segment=segment), "record binary")
    # The sink writes a string's bytes as they are.
    lines = out.select(F.col("record").cast("string").alias("value")).write.option("maxRecordsPerFile", _RECORDS)
    lines.option("encoding", "ISO-8859-1").option("lineSep", member(b"").decode("latin-1")).text(path)


_SEG = pa.schema(
    [(k, pa.string()) for k in ("origin", "type", "payload_digest")] + [(k, pa.int64()) for k in ("number", "total", "page_id", "refers_to")] + [("block", pa.binary())]
)
_SEG_SQL = "origin string, type string, payload_digest string, number long, total long, page_id long, refers_to long, block binary"


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of an archive in pieces: of gzip members, or as it is."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at, z, rest = 0, zlib.decompressobj(31), b""
    while at < len(data) or rest:
        if not rest:
            rest = data[at : at + _INFLATE]
            at += len(rest)
        out = z.decompress(rest, 4 * _INFLATE)
        if out:
            yield out
        rest = z.unconsumed_tail
        if z.eof:
            rest, z = z.unused_data, zlib.decompressobj(31)
            if not rest and at == len(data):
                return
    raise ValueError("the archive ends inside a gzip member")


def parse(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive that comes in pieces; no more is held than a record
    and a piece."""
    held, at, before, source = b"", 0, 0, iter(pieces)

    def more() -> bool:
        nonlocal held, at, before
        piece = next(source, None)
        if piece is None:
            return False
        before += at
        held, at = held[at:] + piece, 0
        return True

    while at < len(held) or more():
        stop = held.find(b"\r\n\r\n", at)
        if held[at : at + 5] != b"WARC/"[: len(held) - at]:
            raise ValueError(f"no record at byte {before + at}")
        if stop < 0:
            if not more():
                raise ValueError(f"the record at byte {before + at} is cut short")
            continue
        lines = held[at:stop].decode().split("\r\n")[1:]
        head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size, start = int(head["content-length"]), stop + 4 - at
        parts = [held[at:]]
        while sum(map(len, parts)) < start + size + 4:
            piece = next(source, None)
            if piece is None:
                raise ValueError(f"the record at byte {before + at} is cut short")
            parts.append(piece)
        before += at
        held, at = b"".join(parts), 0
        if held[start + size : start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {before} is cut short")
        yield head, held[start : start + size]
        at = start + size + 4


_SCAN_BYTES = 8 << 20  # blocks of a batch


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def number(head, key):
        return int(head[key]) if key in head else None

    for batch in batches:
        for data in batch.column(0):
            out, held = {k: [] for k in _SEG.names}, 0
            for head, block in parse(inflated(data.as_py())):
                row = (
                    head.get("warc-segment-origin-id", head["warc-record-id"]),
                    head["warc-type"],
                    head.get("warc-payload-digest"),
                    number(head, "warc-segment-number"),
                    number(head, "warc-segment-total-length"),
                    number(head, "x-page-id"),
                    number(head, "x-refers-to-page-id"),
                    block,
                )
                for k, v in zip(_SEG.names, row, strict=True):
                    out[k].append(v)
                held += len(block)
                if held >= _SCAN_BYTES:
                    yield pa.RecordBatch.from_pydict(out, schema=_SEG)
                    out, held = {k: [] for k in _SEG.names}, 0
            yield pa.RecordBatch.from_pydict(out, schema=_SEG)


_PAGE = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("problem", pa.string()), ("payload", pa.binary())])
_PAGE_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, problem string, payload binary"


def _message(rows: list[dict], payloads: bool) -> dict:
    """One page from its records, ordered by segment number."""
    head, problem = rows[0], None
    block = b"".join(r["block"] for r in rows)
    if head["number"] is not None:
        if [r["number"] for r in rows] != list(range(1, len(rows) + 1)):
            problem = "segments are missing or repeated"
        elif rows[-1]["total"] != len(block):
            problem = "the total length differs"
    said = (head["payload_digest"] or "").removeprefix("sha1:") or None
    size, payload, own = None, None, said
    if problem is None:
        http, _, body = block.partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")[1:])}
        if head["type"] == "revisit":
            size = int(fields.get(b"content-length", 0))
        else:
            try:
                payload = unchunked(body) if fields.get(b"transfer-encoding") == b"chunked" else body
                size, own = len(payload), digest(payload)
                if said and own != said:
                    problem = "the payload digest differs"
            except ValueError as e:
                problem = f"transfer framing: {e}"
    return {"page_id": head["page_id"], "payload_bytes": size, "payload_digest": own, "record_type": head["type"], "refers_to": head["refers_to"], "problem": problem, "payload": payload if payloads else None}


def _assemble(batches: Iterator[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by origin and segment number."""
    held: list[dict] = []
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if held and held[0]["origin"] != r["origin"]:
                out.append(_message(held, payloads))
                held = []
            held.append(r)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=_PAGE)
    if held:
        yield pa.RecordBatch.from_pylist([_message(held, payloads)], schema=_PAGE)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """-> one row per page: (page_id, payload_bytes, payload_digest, record_type,
    refers_to, problem, payload). ``problem`` says what is wrong with segments,
    lengths, framing or digest, and is null for whole records. With
    ``payloads``, a revisit has the payload of the response it refers to.
    Archives of gzip members or plain ones, each of at most 2 GB as stored (no
    more than Spark gives in one row)."""
    prepare(spark)
    files = spark.read.format("binaryFile").load(path).select("content")
    scanned = files.mapInArrow(_scan, _SEG_SQL)
    # A record in one piece needs no company, but travels the same way, so that archives are read once.
    spread = scanned.repartition("origin").sortWithinPartitions("origin", F.col("number").asc_nulls_first())
    pages = spread.mapInArrow(partial(_assemble, payloads=payloads), _PAGE_SQL)
    if not payloads:
        return pages
    pages = cut(pages, "pages")
    own = pages.where("record_type = 'response' and problem is null").select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), F.col("payload").alias("whole"))
    own = own.join(pages.where("record_type = 'revisit'").select(F.col("refers_to").alias("p"), F.col("payload_digest").alias("d")).distinct(), ["p", "d"]).dropDuplicates(["p", "d"])
    told = pages.join(own, (F.col("refers_to") == F.col("p")) & (F.col("payload_digest") == F.col("d")), "left")
    return told.withColumn("payload", F.coalesce("payload", "whole")).drop("p", "d", "whole")


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, segment: int = _SEGMENT) -> DataFrame:
    """Writes archives to the shared folder and returns what reading them gives:
    one row per row of ``pages``. Null html is the empty payload, a null url no
    header value; ids may be null or repeat (see ``write_archives``). Html is
    taken whole, however long, in segments. Only the three named columns are
    read, so others may have any name. An empty table gives an empty table.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "archives")
    write_archives(pages, path, id_col, url_col, html_col, least_bytes, segment)
    return read_archives(spark, path)
