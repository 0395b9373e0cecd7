"""WARC archives of pages, written and read by Spark, with segmented and chunked records.

Writing. A page is an HTTP response record; of pages with equal payloads the one with the smallest
page_id is the response and the others are revisit records that name it. Bodies are framed in
chunked transfer coding. A block longer than `segment` bytes is cut: the first record keeps the
type, continuation records carry the origin's identifier and a segment number, and the last one the
total length. Every record has the fields that WARC/1.1 asks for, its date among them; a revisit names its origin by identifier,
target and date, and by page.

Reading. Method: segment reassembly. Continuation records are grouped by origin identifier,
ordered by segment number, checked against the total length, joined, and the chunked framing is
decoded. Records that were never cut skip the grouping. A revisit gets its payload's figures from
the response it names.

Archives are written and read by Spark's text source, so they are committed whole and can be split. The beginning
of the version line parts the records; the writer places chunk boundaries so that it never occurs in a block.

Other writers' archives, of WARC/1.0 or 1.1, may have it there. `read_foreign` first goes through the lengths of
a file's pieces in order and finds those that a record's Content-Length runs over; only these are joined again.

Defined results
* null html: empty payload. null or empty url: the target `about:blank`. Line ends and version lines in a url are
  percent-encoded.
* null page_id: written without the identifier and read back as null; it is never the smallest.
  If all equal payloads have null identifiers, all of them are responses.
* Rows that repeat the smallest page_id and its payload are all responses; revisits then name them by target,
  date and page only, since no identifier is the one.
* Payloads under `least` bytes are all responses.
* A missing, repeated or short segment, or a wrong digest, raises an error.
* An empty table gives empty archives and an empty result. Other columns are not read.
* A payload of any length is held whole only by the task of its own record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wareflow.llm.rows import map_texts, texts_of
from wareflow.llm.store import new_path

CRLF = b"\r\n"
#: The first line of a record without its line end, what the reader splits at, and what follows a record. No
#: character of the mark recurs in it, as Hadoop's line reader needs.
VERSION, MARK, RECORD_END = "WARC/1.1", "WARC/1.", "\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
#: Responses with copies up to this many are sent to every task of the writer; more are joined.
MOST_SENT = 100_000
#: The date of records that are made without one.
EPOCH = "1970-01-01T00:00:00Z"
SEGMENT, CHUNK = 32 * 1024, 8 * 1024
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer coding; a version line inside the body is cut by a chunk boundary."""
    out, at, mark = [], 0, MARK.encode()
    while at < len(body):
        end = min(at + size, len(body))
        found = body.find(mark, at, min(end + len(mark) - 1, len(body)))
        if found >= 0:
            end = min(end, found + 5)
        out += [b"%x\r\n" % (end - at), body[at:end], CRLF]
        at = end
    return b"".join((*out, b"0\r\n\r\n"))


def dechunked(framed: bytes) -> bytes:
    """The body of a chunked message; extensions and trailers are skipped."""
    out, at = [], 0
    while True:
        line = framed.index(CRLF, at)
        size = int(framed[at:line].split(b";")[0], 16)
        if size == 0:
            return b"".join(out)
        begin = line + 2
        if framed[begin + size : begin + size + 2] != CRLF:
            raise ValueError("a chunk is shorter than it says")
        out.append(framed[begin : begin + size])
        at = begin + size + 2


def _target(url: str | None) -> str:
    return (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A").replace(MARK, MARK.replace("/", "%2F"))


def identifier(name: str) -> str:
    """The record identifier that a name stands for."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, name)}>"


def records(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, name: str, segment: int = SEGMENT, date: str = EPOCH, origin: str | None = None, origin_url: str | None = None) -> Iterator[bytes]:
    """The records of a page, each without its end. origin: the name of the record that a revisit refers to."""
    revisit = refers_to is not None
    block = b"" if revisit else HTTP_HEAD + chunked(payload)
    parts = [block[k : k + segment] for k in range(0, len(block), segment)] or [b""]
    for k, part in enumerate(parts):
        head = {
            "WARC-Type": ("revisit" if revisit else "response") if k == 0 else "continuation",
            "WARC-Record-ID": identifier(name if k == 0 else f"{name}:{k + 1}"),
            "WARC-Date": date,
            "WARC-Target-URI": _target(url),
            "Content-Type": "application/http;msgtype=response",
            "Content-Length": str(len(part)),
        }
        if page_id is not None:
            head["X-Page-ID"] = str(page_id)
        if k == 0:
            head["WARC-Payload-Digest"] = "sha1:" + payload_digest(payload)
        if revisit:
            head["WARC-Profile"] = PROFILE
            if origin is not None:
                head["WARC-Refers-To"] = identifier(origin)
            head["WARC-Refers-To-Target-URI"] = _target(origin_url)
            head["WARC-Refers-To-Date"] = date
            head["X-Refers-To-Page-ID"] = str(refers_to)
        if len(parts) > 1:
            head["WARC-Segment-Number"] = str(k + 1)
            if k:
                head["WARC-Segment-Origin-ID"] = identifier(name)
            if k == len(parts) - 1:
                head["WARC-Segment-Total-Length"] = str(len(block))
        yield f"{VERSION}\r\n{''.join(f'{a}: {b}\r\n' for a, b in head.items())}\r\n".encode() + part


def write_warc(pages: DataFrame, path: str, least: int = 0, segment: int = SEGMENT, most_sent: int = MOST_SENT, compression: str = "none", date: datetime | None = None) -> None:
    """Write page_id, url and html of every row to archives at `path`. date: of all records, by default now."""
    stamp = (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    pages = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("body"))
    pages = pages.withColumn("digest", F.sha1("body"))
    rows = pages.withColumn("long", F.length("body") >= least).groupBy("digest", "page_id").agg(F.min("url").alias("url"), F.count("*").alias("n"), F.max("long").alias("long"))
    first = rows.where("long").groupBy("digest").agg(
        F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", F.col("url").alias("origin_url"), F.col("n").alias("rows")))).alias("first"), F.sum("n").alias("n")
    )
    first = first.where("n > 1 AND first IS NOT NULL").select("digest", "first")
    if first.limit(most_sent + 1).count() <= most_sent:
        first = F.broadcast(first)
    # A page's name follows from its row, so that a revisit knows it, but for rows that repeat or have no id.
    named = pages.join(first, "digest", "left").withColumn("again", F.col("page_id").isNull() | (F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.col("first.rows") > 1)))
    plain = F.concat_ws("-", F.col("page_id").cast("string"), "digest")
    apart = F.concat_ws("-", plain, F.hex(F.monotonically_increasing_id()))
    named = named.withColumn("refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first.page_id")), F.col("first.page_id")))
    origin = F.when(F.col("first.rows") == 1, F.concat_ws("-", F.col("first.page_id").cast("string"), "digest"))
    # Other rows that repeat both their page_id and payload are revisits, and no record refers to them.
    named = named.select("page_id", "url", "body", "refers_to", F.when(F.col("again") | F.col("refers_to").isNotNull(), apart).otherwise(plain).alias("name"), origin.alias("origin"), F.col("first.origin_url").alias("origin_url"))
    if least > 0:  # Payloads below are all responses, so any of their rows may repeat.
        named = named.withColumn("name", F.when(F.length("body") < least, F.concat_ws("-", "name", F.hex(F.monotonically_increasing_id()))).otherwise(F.col("name")))

    def build(part: pa.RecordBatch) -> dict:
        columns = [part.column(c).to_pylist() for c in ("page_id", "url", "body", "refers_to", "name", "origin", "origin_url")]
        return {"value": [r for *row, origin, origin_url in zip(*columns) for r in records(*row, segment, stamp, origin, origin_url)]}

    made = map_texts(named, "body", build, "value binary")
    made.select(F.col("value").cast("string")).write.option("lineSep", RECORD_END).option("compression", compression).text(path)


RECORD = "page_id long, type string, refers_to long, digest string, origin string, number int, total long, target string, date string, block binary"


def head_of(value: bytes) -> tuple[dict[str, str], int] | None:
    """The fields of a record by their names in lower case, and where its block begins; null for bytes that aren't a record's.

    value: what follows the mark. A line that begins with a blank goes on with the field before.
    """
    end = value.find(b"\r\n\r\n")
    if value[:3] not in (b"1\r\n", b"0\r\n") or end < 0:
        return None
    lines = value[3:end].decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
    fields = {a.strip().lower(): b.strip() for a, colon, b in (x.partition(":") for x in lines) if colon}
    return (fields, end + 4) if fields.get("content-length", "").isdecimal() and "warc-record-id" in fields and "warc-type" in fields else None


def parsed(value: bytes) -> tuple | None:
    """The fields of one record, or null for what stands before a file's first version line."""
    if not value.strip():
        return None
    found = head_of(value)
    if found is None:
        raise ValueError(f"not a record: {value[:60]!r}")
    fields, begin = found
    size = int(fields["content-length"])
    if len(value) < begin + size or value[begin + size :].strip(b"\r\n"):
        raise ValueError(f"{fields['warc-record-id']}: the block has {len(value.removesuffix(RECORD_END.encode())) - begin} bytes, not {size}")
    number = lambda key: int(fields[key]) if key in fields else None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") or None
    origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
    named = (fields.get("warc-target-uri"), fields.get("warc-date"))
    return (number("x-page-id"), fields["warc-type"], number("x-refers-to-page-id"), digest, origin, number("warc-segment-number"), number("warc-segment-total-length"), *named, value[begin : begin + size])


def _parse(part: pa.RecordBatch) -> dict:
    rows = [r for v in part.column("value").to_pylist() if (r := parsed(v)) is not None]
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    return dict(zip(names, zip(*rows))) if rows else {c: [] for c in names}


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of archives that write_warc wrote, one row each: continuation records are rows of their own."""
    lines = spark.read.option("lineSep", MARK).text(path).select(F.col("value").cast("binary"))
    return map_texts(lines, "value", _parse, RECORD)


def _runs(pieces: pd.DataFrame) -> pd.DataFrame:
    """The pieces of a file that belong to records of several, with the number of their record and their place in it."""
    pieces = pieces.sort_values(["start", "at"], ignore_index=True)
    size, need = pieces["size"].tolist(), pieces["need"].tolist()
    out, k = [], 1 if len(size) and need[0] < 0 else 0
    if k and size[0]:
        raise ValueError(f"{pieces['file'].iloc[0]}: {size[0]} bytes stand before the first record")
    while k < len(size):
        if need[k] < 0:
            raise ValueError(f"{pieces['file'].iloc[0]}: no record where one should begin")
        end, held = k + 1, size[k]
        while held < need[k] and end < len(size):
            held += len(MARK) + size[end]
            end += 1
        if end > k + 1:
            out += [(pieces["file"][j], pieces["start"][j], pieces["at"][j], k, j - k) for j in range(k, end)]
        k = end
    return pd.DataFrame(out, columns=["file", "start", "at", "record", "place"])


def read_foreign(spark: SparkSession, path: str, scratch) -> DataFrame:
    """Every record of any archives of WARC/1.0 or 1.1, one row each, plain or compressed by record or by file.

    The pieces between marks are written once. A file's lengths, without its bytes, are gone through in
    one task, which finds the pieces that are parts of one block; other pieces are records as they are.
    """
    lines = spark.read.option("lineSep", MARK).text(path)
    lines = lines.select(F.col("value").cast("binary"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))

    def measure(part: pa.RecordBatch) -> dict:
        values = part.column("value").to_pylist()
        heads = [head_of(v) for v in values]
        need = [-1 if h is None else h[1] + int(h[0]["content-length"]) for h in heads]
        return {c: part.column(c) for c in ("value", "file", "start", "at")} | {"size": [len(v) if v.strip() else 0 for v in values], "need": need}

    pieces = scratch.keep(map_texts(lines, "value", measure, "value binary, file string, start long, at long, size long, need long"), "pieces")
    runs = pieces.drop("value").groupBy("file").applyInPandas(_runs, "file string, start long, at long, record long, place long")
    runs = scratch.keep(runs, "runs")
    alone = pieces.join(runs, ["file", "start", "at"], "left_anti").select("value")
    parts = pieces.join(runs, ["file", "start", "at"]).select("file", "record", "place", "value")

    def join(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"value": [MARK.encode().join(part.sort_values("place")["value"])]})

    return map_texts(alone.union(parts.groupBy("file", "record").applyInPandas(join, "value binary")), "value", _parse, RECORD)


def payload_of(block: bytes) -> bytes:
    """The body of an HTTP message, its framing decoded."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def reassembled(parts: pd.DataFrame) -> pd.DataFrame:
    """The whole record of one origin from its segments."""
    parts = parts.sort_values("number")
    total = parts["total"].iloc[-1]
    block = b"".join(parts["block"])
    if list(parts["number"]) != list(range(1, len(parts) + 1)) or total != len(block):
        raise ValueError(f"{parts['origin'].iloc[0]}: segments {list(parts['number'])} hold {len(block)} bytes, not {total}")
    return parts.iloc[:1].assign(block=[block], total=total)


def read_pages(spark: SparkSession, path: str, with_html: bool = True) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest and, if wanted, the html.

    Revisits get payload_bytes from the response with their digest, and no html.
    """
    return pages_of(read_records(spark, path), with_html)


def pages_of(found: DataFrame, with_html: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """The same of records that are read, with some of their columns target and date; other types of records are left out."""
    found = found.where("type IN ('response', 'revisit', 'continuation')")
    whole = found.where("number IS NULL")
    cut = found.where("number IS NOT NULL").groupBy("origin").applyInPandas(reassembled, RECORD)

    def decode(part: pa.RecordBatch) -> dict:
        html, size, digest = [], [], []
        for block, kind, said in zip(texts_of(part.column("block")), part.column("type").to_pylist(), part.column("digest").to_pylist()):
            if kind == "revisit":
                html.append(None)
                size.append(None)
                digest.append(said)
                continue
            payload = payload_of(block)
            own = payload_digest(payload)
            # Some writers take the digest of the body as it was sent, some use other algorithms or none.
            if said is not None and ":" not in said and said not in (own, payload_digest(block.partition(b"\r\n\r\n")[2])):
                raise ValueError(f"a payload doesn't have its digest {said}")
            said = own
            html.append(payload if with_html else None)
            size.append(len(payload))
            digest.append(said)
        return {"page_id": part.column("page_id"), "record_type": part.column("type"), "refers_to": part.column("refers_to"), "payload_bytes": size, "payload_digest": digest, "html": html} | {c: part.column(c) for c in more}

    pages = map_texts(whole.union(cut), "block", decode, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, html binary" + "".join(f", {c} string" for c in more))
    return pages if with_html else pages.drop("html")


def resolved(pages: DataFrame, scratch) -> DataFrame:
    """Read pages with each revisit's payload_bytes taken from the response it names."""
    pages = scratch.keep(pages, "pages")
    revisits = pages.where("record_type = 'revisit'")
    named = revisits.select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    sizes = pages.where("record_type = 'response'").join(named, ["page_id", "payload_digest"], "left_semi").groupBy("payload_digest").agg(F.min("payload_bytes").alias("n_"))
    filled = revisits.join(sizes, "payload_digest", "left").withColumn("payload_bytes", F.col("n_"))
    return pages.where("record_type <> 'revisit'").unionByName(filled.select(pages.columns))


def round_trip(pages: DataFrame, scratch, least: int = 0, **how) -> DataFrame:
    """Write every page to archives in the shared folder, read them back and report each page."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(pages, path, least, **how)
    out = resolved(read_pages(spark, path, with_html=False), scratch)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
