"""WARC archives of web pages: a writer by Spark's file sink, and a reader that salvages what damage leaves.

Writer: each page is a record. Of pages with equal payloads of at least ``least`` bytes, the one with the largest page_id is written in full,
the others are revisits that name it and carry its HTTP header only. Equal payloads meet by their SHA-256 in a left join with the groups
of more than one page, whose large partitions Spark can split. Tasks turn rows into records, each a gzip member of its own (or plain), and the
text sink writes them as they are, so files appear only when their task commits, in any file system that Hadoop writes. The sink puts
one fixed byte after each row: a member's last byte is that byte already, so it is left to the sink. Files are named by the sink.

Reader: a task gets whole archives, whose size the writer bounds by the mean record. A position must hold a gzip member that inflates with
its checksum, or a plain version line; its records must have a header, a length that reaches the end mark, and digests that hold. After a failed check
the reader searches for the next member or version line that passes them, so one damaged record costs only itself, and logs the bytes
between as a gap with the first reason. Members may hold several records; a damaged one among them is a gap inside its member.

Defined results: a null payload is the empty one. A null page_id is smaller than all others; of rows that repeat the largest page_id and the payload one
is written in full. URLs are percent-encoded where a header cannot hold them; a null URL has no header. Texts without any record give one gap; empty files give
nothing. Other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
import zlib
from base64 import b32encode
from collections.abc import Callable, Iterator
from hashlib import sha1
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_rows, saved, shared_dir, slices

#: The end of a record, the start of a gzip member and of a plain record, the profile of revisits.
END, GZIP, PLAIN = b"\r\n\r\n", b"\x1f\x8b\x08", b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
NEEDED = {"warc-type", "warc-record-id", "warc-date", "content-length"}
#: A file gets about so many bytes of payloads.
ARCHIVE_BYTES = 64_000_000
#: A header longer than this is damage.
HEADER_BYTES = 1 << 16
#: So is a member that gives nothing for its first bytes, as false marks do whose header would never end.
GZIP_HEADER_BYTES = 1 << 12


def base32_sha1(data: bytes) -> str:
    return b32encode(sha1(data).digest()).decode()


def gzip_member(data: bytes) -> bytes:
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(data) + packed.flush()


def record_bytes(kind: str, record_id: str, date: str, url: str | None, payload: bytes, refers_to: str | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    lines += [] if url is None else [f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}"]
    lines += [] if refers_to is None else [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def page_urn(page_id: Column, row: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def page_of(urn: Column) -> Column:
    """The page_id in a record's id; null if it has none."""
    return F.nullif(F.regexp_extract(urn, r"^<urn:page:([^:]*):", 1), F.lit("")).cast("long")


def write_archives(
    pages: DataFrame, folder: str, date: str, least: int = 0, compress: bool = True, archive_bytes: int = ARCHIVE_BYTES, torn: Column | None = None, page_id: str = "page_id", url: str = "url", html: str = "html"
) -> None:
    """Write ``pages`` below ``folder``. Records of rows of ``torn`` stand there twice, the first time cut in the middle, as a writer leaves them that failed and began again."""
    payload = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"), (F.lit(False) if torn is None else F.coalesce(torn, F.lit(False))).alias("torn"))
    rows = saved(rows.withColumns({"row": F.monotonically_increasing_id(), "key": F.sha2("payload", 256), "size": F.length("payload").cast("long")}), "pages")
    bulk = rows.agg(F.count("*"), F.sum("size")).first()
    groups = rows.where(F.col("size") >= least).groupBy("key").agg(F.max(F.struct("page_id", "row")).alias("head"), F.count("*").alias("n")).where("n > 1")
    heads = saved(groups.select("key", F.col("head.row").alias("head"), page_urn(F.col("head.page_id"), F.col("head.row")).alias("refers_to")), "heads")
    told = rows.join(heads, "key", "left").select(page_urn(F.col("page_id"), F.col("row")).alias("id"), "url", "payload", "torn", F.when(F.col("head") != F.col("row"), F.col("refers_to")).alias("refers_to"))

    def make():
        empty = gzip_member(b"")

        def records(cols):
            out = []
            for i, u, data, cut, refers_to in zip(cols["id"], cols["url"], cols["payload"], cols["torn"], cols["refers_to"], strict=True):
                data = record_bytes("response" if refers_to is None else "revisit", i, date, u, data, refers_to)
                if compress:
                    data = gzip_member(data)
                    data += b"" if data[-1] == 0 else empty  # records of 16 MB and more
                out.append((data[: len(data) // 2] if cut else b"") + data[: -1 if compress else -len(END)])
            return {"value": out}

        return records

    members = map_rows(told, make, "value binary", rows=500).select(F.col("value").cast("string").alias("value"))
    per_file = max(1, archive_bytes * bulk[0] // max(1, bulk[1] or 0))
    members.write.option("lineSep", "\0" if compress else END.decode()).option("maxRecordsPerFile", per_file).text(folder)
    discard(rows, heads)


class Damaged(Exception):
    """What stands here is no valid record."""


def inflated(data: bytes, at: int) -> tuple[bytes, int]:
    """The gzip member that starts at ``at``, and where it ends."""
    stream, out, end, step = zlib.decompressobj(31), [], at, GZIP_HEADER_BYTES
    while not stream.eof:
        piece = data[end : end + step]
        if not piece:
            raise Damaged("the member is cut short")
        try:
            out.append(stream.decompress(piece))
        except zlib.error as e:
            raise Damaged(f"the member does not inflate: {e}") from e
        end, step = end + len(piece), min(4 * step, 1 << 20)
        if not out[0] and not stream.eof:
            raise Damaged("nothing inflates")
    return b"".join(out), end - len(stream.unused_data)


def parsed_record(data: bytes, at: int) -> tuple[dict, int]:
    """The plain record that starts at ``at``, all its checks passed, and where it ends."""
    if not data.startswith(PLAIN, at):
        raise Damaged("no record starts here")
    stop = data.find(END, at, at + HEADER_BYTES)
    if stop < 0:
        raise Damaged("the header has no end")
    fields, (version, *lines) = {}, data[at:stop].split(b"\r\n")
    if version not in VERSIONS:
        raise Damaged("no version line")
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("a header line without a name")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not NEEDED <= fields.keys() or not fields["content-length"].isascii() or not fields["content-length"].isdigit():
        raise Damaged("a header field is missing")
    first = stop + len(END)
    end = first + int(fields["content-length"])
    if not data.startswith(END, end):
        raise Damaged("the length does not reach the record's end")
    block = data[first:end]
    http = block.find(END)
    payload = block[http + len(END) :] if http >= 0 and fields.get("warc-type") == "response" else b"" if fields.get("warc-type") == "revisit" else block
    for name, held in (("warc-block-digest", block), ("warc-payload-digest", payload if fields.get("warc-type") != "revisit" else None)):
        if held is not None and fields.get(name, "").startswith("sha1:") and fields[name][5:] != base32_sha1(held):
            raise Damaged(f"{name} does not hold")
    size = len(payload)
    if fields.get("warc-type") == "revisit":  # its HTTP header tells the length of what it revisits
        told = [line.partition(b":")[2].strip() for line in block[: max(http, 0)].split(b"\r\n") if line.lower().startswith(b"content-length:")]
        size = int(told[0]) if told and told[0].isdigit() else None
    return {"fields": fields, "payload": payload, "payload_bytes": size}, end + len(END)


def salvaged(data: bytes, inside: bool = False) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(start, end, record, null) of each valid record and (start, end, null, reason) of each gap, in their order."""
    at, gap, reason = 0, None, None
    ahead = {GZIP: -1, PLAIN: -1}  # the next place of each mark: searched again only when passed
    while at < len(data):
        try:
            if not inside and data.startswith(GZIP, at):
                text, end = inflated(data, at)
                found = [(at, end, r, None if why is None else f"in the member, bytes {a} to {b}: {why}") for a, b, r, why in salvaged(text, inside=True)]
                if text and not any(r for _, _, r, _ in found):
                    raise Damaged("a member without records")
            else:
                record, end = parsed_record(data, at)
                found = [(at, end, record, None)]
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            for mark, place in ahead.items():
                if place <= at:
                    place = data.find(mark, at + 1)
                    ahead[mark] = len(data) if place < 0 else place
            at = ahead[PLAIN] if inside else min(ahead.values())
            continue
        if gap is not None:
            yield gap, at, None, reason
            gap = None
        yield from found
        at = end
    if gap is not None:
        yield gap, len(data), None, reason


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``folder``: path, start, stop, record_type, record_id, refers_to, url, payload_digest, payload_bytes, payload, gap.

    ``gap`` is null for records and the reason for quarantined bytes, which have none of the fields between. A task holds an
    archive and its records of one batch; ``payload=False`` leaves payloads out after their check.
    """
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("refers_to", pa.string()),
                        ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary()), ("gap", pa.string())])

    def row(path: str, start: int, stop: int, record: dict | None, why: str | None) -> tuple:
        if record is None:
            return path, start, stop, *[None] * 7, why
        f = record["fields"]
        digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or base32_sha1(record["payload"])
        return path, start, stop, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-refers-to"), f.get("warc-target-uri"), digest, record["payload_bytes"], record["payload"] if payload else None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush: Callable[[list], pa.RecordBatch] = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
        for cols in slices(batches, rows=1):
            rows, held = [], 0
            for found in salvaged(cols["content"][0]):
                rows.append(row(cols["path"][0], *found))
                held += len(rows[-1][9] or b"") + 300
                if held > 8_000_000:
                    yield flush(rows)
                    rows, held = [], 0
            if rows:
                yield flush(rows)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    return files.mapInArrow(run, "path string, start long, stop long, record_type string, record_id string, refers_to string, url string, payload_digest string, payload_bytes long, payload binary, gap string")


def archived_pages(pages: DataFrame, date: str, **options) -> DataFrame:
    """``pages`` written to a new folder below the shared one, and what ``read_archives`` finds there, records and gaps."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, folder, date, **options)
    return read_archives(spark, folder, payload=False)


#: The query's rows as DuckDB SQL.
ORACLE = """
WITH given AS (SELECT page_id, coalesce(html, '') AS h, row_number() OVER () AS r FROM pages),
ranked AS (SELECT page_id, h, sha1(h) AS s, row_number() OVER (PARTITION BY h ORDER BY page_id DESC NULLS LAST, r) AS k, max(page_id) OVER (PARTITION BY h) AS head FROM given)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(s, (j // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (j % 4))) & 31) + 1)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN head END AS refers_to FROM ranked"""
