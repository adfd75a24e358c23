"""WARC archives: writing with revisits and segments, and reading back with segment reassembly."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, reachable, scratch_path, stage

CRLF = b"\r\n"
#: Payloads from this size on are stored once; blocks beyond SEGMENT bytes are split; bodies are framed in CHUNK bytes.
REVISIT_BYTES, SEGMENT, CHUNK = 100, 4096, 1024
#: What stands between records, up to the name of the next one's format; bytes of a record and of its header that are believed.
MAGIC = b"WARC/"
SEPARATOR = b"\r\n\r\n" + MAGIC
LONGEST, LONGEST_HEAD = 1 << 30, 1 << 20
DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """Undoes chunked(); chunk extensions and trailers are skipped. ValueError if the framing is broken or ends early."""
    parts, at = [], 0
    while True:
        end = body.index(CRLF, at)
        n = int(body[at:end].split(b";")[0], 16)
        if not n:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + n])
        at = end + 4 + n
        if len(parts[-1]) != n or body[at - 2 : at] != CRLF:
            raise ValueError("a chunk is cut short")


def _record(kind: str, rid: str, url: str, block: bytes, **more: object) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{rid}>", "WARC-Date": DATE, "WARC-Target-URI": url, **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": len(block)}
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block


def _records(page: int | None, url: str, payload: bytes, digest: str, first: int | None, revisit: bool, segment: int) -> Iterator[bytes]:
    rid = lambda p, n: f"urn:page:{'null' if p is None else p}:{digest[:16]}:{n}"
    url = "".join((url or "about:blank").split()) or "about:blank"
    http = {"Content_Type": "application/http; msgtype=response", "WARC_Payload_Digest": f"sha256:{digest}"}
    if revisit:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        yield _record("revisit", rid(page, 1), url, block, **http, WARC_Refers_To=f"<{rid(first, 1)}>", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        yield _record("response", rid(page, 1), url, block, **http)
        return
    yield _record("response", rid(page, 1), url, parts[0], **http, WARC_Segment_Number=1)
    for n, part in enumerate(parts[1:], 2):
        yield _record("continuation", rid(page, n), url, part, WARC_Segment_Origin_ID=f"<{rid(page, 1)}>", WARC_Segment_Number=n, WARC_Segment_Total_Length=len(block) if n == len(parts) else None)


def _written(segment: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[bytes] = []
            for r in batch.to_pylist():
                rows += _records(r["page_id"], r["url"], r["payload"], r["digest"], r["first"], r["revisit"], segment)
                if sum(map(len, rows[-64:])) > 1 << 22 or len(rows) >= 512:
                    yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["record"])

    return run


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Writes a record per page into gzip-compressed WARC files under path: one file per task, records closed by two line ends.

    Of equal payloads of at least REVISIT_BYTES bytes the one with the least page_id is a response and the others revisit it; rows that share that id are responses all. Null html is an
    empty payload. Rows with a null page_id are revisits where an equal payload has an id.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    many = p.filter(F.length("payload") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    p = attach(p, stage(many, "warc-equal"), ["digest"]).withColumn("revisit", F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
    lines = p.mapInArrow(_written(segment), "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(path)


def parse_records(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes, bool]]:
    """(header fields in lower case, block, whole) of each record of one archive, which comes in pieces cut at SEPARATOR.

    The length in the header tells where a record ends, so one whose block holds the separator takes several pieces. A record without a proper length, or longer than what is left of the
    archive, comes out as not whole, and reading goes on with the next piece. At most one record is held, or what follows one that states too great a length.
    """
    todo: list[bytes] = []
    source = iter(pieces)
    first = True
    while True:
        data, used, head, n = b"", 0, None, None
        while True:  # take pieces until the record is full
            if used == len(todo):
                nxt = next(source, None)
                if nxt is None:
                    break
                todo.append(nxt if first and nxt.startswith(MAGIC) else MAGIC + nxt)
                first = False
            data = todo[used] if not used else data + SEPARATOR[: -len(MAGIC)] + todo[used]
            used += 1
            if head is None and (end := data.find(2 * CRLF)) >= 0:
                head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[:end].decode("utf-8", "replace").split("\r\n")[1:])}
                n = int(head["content-length"]) if re.fullmatch("[0-9]{1,10}", head.get("content-length", "")) else None
                if n is None or n > LONGEST:
                    break
            if head is not None and len(data) >= end + 4 + n:
                break
            if head is None and len(data) > LONGEST_HEAD:
                break
        if not used:
            return
        if head is not None and n is not None and len(data) >= end + 4 + n:
            yield head, data[end + 4 : end + 4 + n], True
        else:
            if head is not None or todo[0].strip():
                yield head or {}, b"", False
            used = 1
        del todo[:used]


def _payload(block: bytes) -> tuple[bytes | None, dict[str, str]]:
    """The body of an HTTP message without its framing (null if that is broken), and its header fields."""
    head, _, body = block.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    if fields.get("transfer-encoding", "").lower() != "chunked":
        return body, fields
    try:
        return unchunked(body), fields
    except ValueError:
        return None, fields


_SEEN = "record_id string, record_type string, refers_to string, digest string, payload_bytes long, payload binary, complete boolean, origin string, number int, total long"


def _number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch("[0-9]{1,9}", text) else None


def _row(h: dict[str, str], block: bytes, whole: bool) -> tuple | None:
    bare = lambda k: h[k].strip("<>") if k in h else None
    kind, number = h.get("warc-type"), _number(h.get("warc-segment-number"))
    digest = h.get("warc-payload-digest", "").removeprefix("sha256:") or None
    if not whole:
        return (bare("warc-record-id"), kind, None, digest, None, None, False, None, None, None)
    if kind not in ("response", "revisit", "continuation"):
        return None
    if number:
        return (bare("warc-record-id"), kind, None, digest, None, block, True, bare("warc-segment-origin-id") or bare("warc-record-id"), number, _number(h.get("warc-segment-total-length")))
    payload, fields = _payload(block)
    size = (_number(fields.get("content-length")) or 0) if kind == "revisit" else None if payload is None else len(payload)
    return (bare("warc-record-id"), kind, bare("warc-refers-to"), digest, size, payload, payload is not None, None, None, None)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole records, payload decoded, and of the raw parts of those that were split (which have a number). Rows in: file, piece; a file's pieces in a row, in order."""
    kinds = [pa.string()] * 4 + [pa.int64(), pa.binary(), pa.bool_(), pa.string(), pa.int32(), pa.int64()]
    names = [x.split()[0] for x in _SEEN.split(", ")]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * len(names), kinds, strict=True)], names)
    rows, held = [], 0
    pieces = ((f, x.as_buffer().to_pybytes()) for batch in batches for f, x in zip(batch.column("file").to_pylist(), batch.column("piece"), strict=True))
    for _, of in groupby(pieces, key=itemgetter(0)):
        for h, block, whole in parse_records(y for _, x in of for y in x.split(SEPARATOR)):
            if (r := _row(h, block, whole)) is not None:
                rows.append(r)
                held += len(block)
            if held > 1 << 23 or len(rows) >= 2048:
                yield pack(rows)
                rows, held = [], 0
    yield pack(rows)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [_payload(b"".join(b))[0] if ok else None for b, ok in zip(batch.column("blocks").to_pylist(), batch.column("complete").to_pylist(), strict=True)]
        sizes = pa.array([None if x is None else len(x) for x in out], pa.int64())
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("record_id", "digest", "copies")], sizes, pa.array(out, pa.binary()), pa.array([x is not None for x in out])], ["record_id", "digest", "copies", "payload_bytes", "payload", "complete"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, refers_to, digest, payload_bytes, payload, complete for each response and revisit of the archives under path.

    Archives are read once, as text with the record separator for a line end: gzip-compressed ones (*.gz, of one member or many) as a stream, of which one record is held at a time; others whole.
    Split records are put together: parts are grouped by the id of their first record, ordered by number, and joined when the numbers have no gap and the lengths add up to the
    total that the last part states; chunked framing is undone after that. A part that occurs twice counts once; a first record that occurs twice gives two rows. Only split records are
    shuffled. Revisits have the size of what they revisit from their HTTP header. Records with parts missing, with a cut or unreadable header, with a wrong length or with
    broken framing have complete = false and no payload, whatever of id and type can't be read is null; all others are read none the less.
    """
    reachable(spark)
    piece = [F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")]
    text = spark.read.schema("value string")
    packed = F.endswith(F.col("_metadata.file_name"), F.lit(".gz"))  # decides when files are listed
    zipped = text.option("lineSep", SEPARATOR.decode()).text(path).filter(packed).select(piece)
    plain = text.option("wholetext", True).text(path).filter(~packed).select(piece)
    seen = stage(zipped.unionByName(plain).mapInArrow(_read, _SEEN), "warc-records")
    out = ["record_id", "record_type", "refers_to", "digest", "payload_bytes", "payload", "complete"]
    part = F.struct("number", F.col("payload").alias("block"))
    by = seen.filter("number is not null").groupBy("origin").agg(F.array_sort(F.collect_set(part)).alias("parts"), F.max("total").alias("total"), F.max("digest").alias("digest"), F.count(F.when(F.col("number") == 1, 1)).alias("copies"))
    length = F.aggregate("parts", F.lit(0).cast("long"), lambda a, x: a + F.length(x["block"]))
    ok = (F.element_at("parts", -1)["number"] == F.size("parts")) & (length == F.col("total")) & (F.col("copies") > 0)
    by = by.withColumn("complete", F.coalesce(ok, F.lit(False))).withColumn("copies", F.greatest("copies", F.lit(1).cast("long")))
    by = by.select(F.col("origin").alias("record_id"), "digest", "copies", "complete", F.transform("parts", lambda x: x["block"]).alias("blocks"))
    by = by.mapInArrow(_joined, "record_id string, digest string, copies long, payload_bytes long, payload binary, complete boolean")
    by = by.withColumn("_c", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).withColumns({"record_type": F.lit("response"), "refers_to": F.lit(None).cast("string")})
    return seen.filter("number is null").select(out).unionByName(by.select(out))


def archive_round_trip(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Writes pages as archives into the shared folder and reads them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, segment)
    got = read_archives(spark, path)
    page = lambda c: F.expr(f"try_cast(split_part({c}, ':', 3) as bigint)")
    digest = F.when(F.col("record_type") == "response", F.sha2("payload", 256)).otherwise(F.col("digest"))
    return got.select(page("record_id").alias("page_id"), "payload_bytes", digest.alias("payload_digest"), "record_type", page("refers_to").alias("refers_to"), "complete")
