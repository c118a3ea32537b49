"""WARC archives: writing pages as records, and a salvage reader.

Writing. Every record is a gzip member of its own. The members go through Spark's text writer,
so any store Spark can write to will do; it ends each archive with an empty member, which a gzip stream may
hold anywhere. An archive is cut by the bytes it holds, however large pages lie. Of equal payloads (sha1 and length) of at least ``min_revisit_bytes``,
the record with the largest id is the response and the others are revisits that refer to it.

Reading. Archives are read as binary files, one a row. Each record is checked: member checksum,
version line, header block, content length, block digest, payload digest and the closing blank
lines. After a failed check the reader searches the next gzip member or version line (also inside a
member) that starts a valid record, goes on there and logs the bytes between as a quarantined gap.

Defined results: NULL payload counts as empty; NULL ids are kept (as records without a number)
but are never referred to while another copy has an id; rows that repeat the largest id are all
responses; an empty table writes and reads back no record; extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripsense.llm.common import broadcast_if_small, scratch, text_or_empty

#: bytes of members at which an archive file is full
ARCHIVE_BYTES = 32 << 20
#: a gzip member without content (RFC 1952)
_EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
_MEMBER = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
_END = b"\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(record_id: str, url: str, payload: bytes, refers_to: str | None = None) -> bytes:
    """One record, uncompressed. A revisit keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{record_id}>",
            "WARC-Date: 1970-01-01T00:00:00Z", "WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url)]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def member(data: bytes) -> bytes:
    """A gzip member (no name, no time, so equal records give equal bytes)."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               min_revisit_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write all rows of ``pages`` as archives under ``path``: each row of text is an archive, cut once its members
    reach ``archive_bytes`` (so it exceeds them by less than its last record)."""
    rows = pages.select(F.col(id_col).cast("string").alias("_id"), F.col(id_col).alias("_order"),
                        F.coalesce(F.col(url_col), F.lit("")).alias("_url"), text_or_empty(payload_col).alias("_payload"))
    rows = rows.withColumn("_size", F.octet_length("_payload").cast("long")).withColumn(
        "_digest", F.unhex(F.sha1("_payload")))
    sizes = (rows.filter(F.col("_size") >= min_revisit_bytes).groupBy("_digest", "_size")
             .agg(F.max("_order").cast("string").alias("_first"), F.count(F.lit(1)).alias("_copies")))
    copies = sizes.filter("_copies > 1").drop("_copies")
    copies = broadcast_if_small(copies, row_bytes=64)
    linked = (rows.drop("_order").join(copies, ["_digest", "_size"], "left")
              .select("_id", "_url", "_payload", F.when(~F.col("_id").eqNullSafe(F.col("_first")), F.col("_first")).alias("_refers")))

    def pack(stream):
        import pyarrow as pa

        archive, size = [], 0
        whole = lambda: pa.RecordBatch.from_arrays([pa.array([b"".join(archive)], pa.binary())], ["value"])
        for batch in stream:
            for i, u, p, r in zip(*(c.to_pylist() for c in batch.columns)):
                archive.append(member(record_bytes("" if i is None else i, u, p.encode("utf-8"), r)))
                size += len(archive[-1])
                if size >= archive_bytes:
                    yield whole()
                    archive, size = [], 0
        if archive:
            yield whole()

    (linked.mapInArrow(pack, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
     .option("maxRecordsPerFile", 1).mode("overwrite").text(path))


class _Bad(Exception):
    pass


def parse_record(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """Header, block and end of the record at ``at`` of plain WARC bytes; raises ``_Bad`` if a check fails."""
    m = _VERSION.match(data, at)
    if not m:
        raise _Bad("no version line")
    stop = data.find(_END, m.end())
    if stop < 0:
        raise _Bad("header without end")
    head = {}
    for line in data[m.end():stop].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            raise _Bad("header line without colon")
        head[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isdigit():
        raise _Bad("no content length")
    begin = stop + 4
    end = begin + int(head["content-length"])
    if data[end:end + 4] != _END:
        raise _Bad("record does not end where its length says")
    block = data[begin:end]
    if "warc-block-digest" in head and head["warc-block-digest"] != "sha1:" + digest32(block):
        raise _Bad("block digest differs")
    if head.get("warc-type") == "response":
        _, gap, payload = block.partition(_END)
        if gap and head.get("warc-payload-digest", "").startswith("sha1:") and head["warc-payload-digest"] != "sha1:" + digest32(payload):
            raise _Bad("payload digest differs")
    return head, block, end + 4


def read_member(data: memoryview, at: int, size: int = 1 << 16) -> tuple[bytes, int, str]:
    """Content and end of the gzip member at ``at``, read in pieces, and what is wrong with it (empty: nothing).

    A damaged member gives what it holds before its error, and the place of the error.
    """
    unpacker, out, pos = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof and pos < len(data):
            before, piece = unpacker.copy(), data[pos:pos + size]
            out.append(unpacker.decompress(piece))
            pos += len(piece)
    except zlib.error as e:
        unpacker, piece = before, data[pos:pos + size]    # the failed piece again, by halves
        while len(piece) > 1:
            half, trial = piece[:len(piece) // 2], unpacker.copy()
            try:
                out.append(trial.decompress(half))
            except zlib.error:
                piece = half
            else:
                unpacker, pos, piece = trial, pos + len(half), piece[len(half):]
        return b"".join(out), pos, f"gzip member: {e}"
    if not unpacker.eof:
        return b"".join(out), pos, "gzip member is cut off"
    return b"".join(out), pos - len(unpacker.unused_data), ""


def member_records(plain: bytes) -> tuple[list[tuple[dict, bytes, int, int]], list[tuple[int, int, str]]]:
    """Valid records of a member's content ``(header, block, from, to)`` and the gaps ``(from, to, reason)`` between."""
    found, gaps, pos, bad_from, reason = [], [], 0, None, ""
    while pos < len(plain):
        try:
            head, block, stop = parse_record(plain, pos)
        except _Bad as e:
            if bad_from is None:
                bad_from, reason = pos, str(e)
            m = _VERSION.search(plain, pos + 1)
            pos = m.start() if m else len(plain)
            continue
        if bad_from is not None:
            gaps.append((bad_from, pos, reason))
            bad_from = None
        found.append((head, block, pos, stop))
        pos = stop
    if bad_from is not None:
        gaps.append((bad_from, len(plain), reason))
    return found, gaps


class _Forward:
    """The next match at or after a place. What one search has found answers all later ones up to there, so the
    bytes of an archive are searched once however many records are damaged."""

    def __init__(self, find):
        self.find, self.begin, self.found = find, None, None

    def __call__(self, at: int) -> int | None:
        if self.begin is None or at < self.begin or self.found is not None and at > self.found:
            self.begin, self.found = at, self.find(at)
        return self.found


def salvage(data: bytes):
    """All valid records of an archive and its gaps: ``("record", offset, length, header, block)`` and
    ``("gap", offset, length, reason)``, in order.

    Gaps inside an intact member have the member's offset and length. Of a damaged member (cut off, or its
    checksum differs) the records with a block digest are kept; a record alone in its member stands or
    falls with the member. The length of records of a damaged member is 0.
    """
    view, at, end = memoryview(data), 0, len(data)
    next_version = _Forward(lambda k: getattr(_VERSION.search(data, k), "start", lambda: None)())
    next_member = _Forward(lambda k: None if (m := data.find(_MEMBER, k)) < 0 else m)
    bad_from, reason = None, ""
    while at < end:
        found, gaps, wrong, search = [], [], "", at + 1
        if data.startswith(_MEMBER, at):
            plain, stop, wrong = read_member(view, at)
            found, gaps = member_records(plain)
            if wrong:
                alone = len(found) == 1 and not found[0][2] and not plain.startswith(b"WARC/", found[0][3])
                found = [] if alone else [x for x in found if "warc-block-digest" in x[0]]
                search = stop if found else search        # stored bytes are not read twice
        else:
            try:
                head, block, stop = parse_record(data, at)
                found.append((head, block, at, stop))
            except _Bad as e:
                wrong = str(e)
        if wrong:
            for head, block, *_ in found:
                yield "record", at, 0, head, block
            if bad_from is None:
                bad_from, reason = at, wrong
            at = min((x for x in (next_member(at + 1), next_version(search)) if x is not None), default=end)
            continue
        if bad_from is not None:
            yield "gap", bad_from, at - bad_from, reason, b""
            bad_from = None
        for head, block, *_ in found:
            yield "record", at, stop - at, head, block
        for a, b, why in gaps:
            yield "gap", at, stop - at, f"{why} (bytes {a} to {b} of the member's content)", b""
        at = stop
    if bad_from is not None:
        yield "gap", bad_from, end - bad_from, reason, b""


SCHEMA = ("kind string, archive string, byte_offset bigint, byte_length bigint, reason string, record_id string, record_type string, "
          "target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary")


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records (``kind = 'record'``) and quarantined gaps (``kind = 'gap'``) of all archives under ``path``."""
    def parse(stream):
        import pyarrow as pa

        names = [p.split()[0] for p in SCHEMA.split(", ")]
        types = [pa.string(), pa.string(), pa.int64(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
        urn = lambda x: x[10:-1] if x and x.startswith("<urn:page:") else x
        for batch in stream:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for kind, at, length, head, block in salvage(content.as_py()):
                    if kind == "gap":
                        rows.append((kind, archive, at, length, head, *[None] * 7))
                    else:
                        http, _, payload = block.partition(_END)
                        stated = re.search(rb"(?im)^content-length:\s*(\d+)", http)
                        revisit = head.get("warc-type") == "revisit"
                        n = int(stated[1]) if revisit and stated else len(payload)
                        rows.append((kind, archive, at, length, None, urn(head.get("warc-record-id")), head.get("warc-type"),
                                     head.get("warc-target-uri"), urn(head.get("warc-refers-to")),
                                     head.get("warc-payload-digest", "").removeprefix("sha1:") or digest32(payload), n,
                                     None if revisit or not with_payload else payload))
                        size += len(payload) * with_payload
                    if len(rows) == 5000 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, SCHEMA)


def op6(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    write_warc(pages, path, min_revisit_bytes=min_revisit_bytes)
    found = read_warc(spark, path, with_payload=False).filter("kind = 'record'")
    return found.select(F.expr("try_cast(record_id AS bigint)").alias("page_id"), "payload_bytes", "payload_digest",
                        "record_type", F.expr("try_cast(refers_to AS bigint)").alias("refers_to"))


SQL = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, unhex(sha1(coalesce(html, ''))) AS d FROM pages),
g AS (SELECT d, octet_length(b) AS n, max(page_id) AS top FROM p GROUP BY 1, 2),
bits AS (SELECT DISTINCT d, list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + CAST(concat('0b', substr(CAST(CAST(d AS BIT) AS VARCHAR), 1 + 5 * k, 5)) AS INTEGER), 1)) AS c FROM p)
SELECT p.page_id, octet_length(p.b) AS payload_bytes, array_to_string(bits.c, '') AS payload_digest,
  CASE WHEN p.page_id = g.top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN p.page_id <> g.top THEN g.top END AS refers_to
FROM p JOIN g ON p.d = g.d AND octet_length(p.b) = g.n JOIN bits ON bits.d = p.d"""
