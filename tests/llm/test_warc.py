"""Archives: exact round trips, and records that are damaged."""

import base64
import glob
import gzip
import hashlib
import random
from collections import Counter
from datetime import UTC, datetime
from pathlib import Path

import pandas as pd
import pytest

from tests.llm.conftest import rows_of
from wareflow.llm import warc
from wareflow.llm.store import new_path

COLUMNS = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def pages(spark, rows):
    return spark.createDataFrame([(a, b, c, "x", 1) for a, b, c in rows], "page_id LONG, url STRING, html STRING, digest STRING, first LONG").repartition(3)


def expected(rows, least=0):
    first = {}
    for page_id, _, html in rows:
        if page_id is not None:
            first[html or ""] = min(page_id, first.get(html or "", page_id))
    out = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        leader = first.get(html or "") if len(body) >= least else page_id
        refers_to = None if leader is None or leader == page_id else leader
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        out.append((page_id, len(body), digest, "response" if refers_to is None else "revisit", refers_to))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/\r\nX: y", "é€" * 9000), (2, "u WARC/1.1", "é€" * 9000), (3, None, None), (4, "u", ""), (None, "u", "é€" * 9000),
    (5, "u", "WARC/1.1"), (6, "u", "aWARC/1.1\r\nbWARC/1.1WARC/1.1\r\n\r\n"), (6, "u", "aWARC/1.1\r\nbWARC/1.1WARC/1.1\r\n\r\n"),
    (7, "u", "\r\n\r\nWWARC/1.1\r\n" * 300), (None, "u", "alone"), (None, "v", "alone"), (8, "é", "x" * 400_000),
]


@pytest.mark.parametrize("segment, least, most_sent", [(100, 0, 10), (warc.SEGMENT, 0, 0), (5000, 20, 10)])
def test_round_trip(spark, scratch, segment, least, most_sent):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "60000")
    got = warc.round_trip(pages(spark, ROWS), scratch, least, segment=segment, most_sent=most_sent)
    assert rows_of(got, *COLUMNS) == expected(ROWS, least)
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_html_comes_back(spark):
    path = new_path(spark, "test")
    warc.write_warc(pages(spark, ROWS), path, segment=1000, compression="gzip")
    got = {r.page_id: bytes(r.html).decode() for r in warc.read_pages(spark, path).where("record_type = 'response' AND page_id IS NOT NULL").collect()}
    assert got == {a: c or "" for a, _, c in ROWS if a in (1, 3, 5, 6, 7, 8)}


def test_empty_table(spark, scratch):
    assert warc.round_trip(pages(spark, []), scratch).count() == 0


def test_chunked_framing():
    rng = random.Random(3)
    for _ in range(200):
        body = b"".join(rng.choice([b"WARC/1.1", b"W", b"\r\n", b"x", b"WARC/"]) for _ in range(rng.randrange(40)))
        framed = warc.chunked(body, rng.randrange(1, 20))
        assert warc.dechunked(framed) == body and b"WARC/1." not in framed
    with pytest.raises(ValueError):
        warc.dechunked(b"5\r\nabc\r\n0\r\n\r\n")
    assert warc.dechunked(b"3;x=y\r\nabc\r\n0\r\nT: u\r\n\r\n") == b"abc"


def test_missing_segments_are_noticed():
    parts = [warc.parsed(r.removeprefix(b"WARC/1.") + b"\r\n\r\n") for r in warc.records(1, "u", b"a" * 500, None, "n", 100)]
    names = [x.split(" ")[0] for x in warc.RECORD.split(", ")]
    whole = pd.DataFrame(parts, columns=names).sample(frac=1, random_state=1)
    assert warc.payload_of(warc.reassembled(whole)["block"].iloc[0]) == b"a" * 500
    for bad in (whole[whole["number"] != 2], pd.concat([whole, whole[whole["number"] == 1]])):
        with pytest.raises(ValueError):
            warc.reassembled(bad)


def test_records_have_the_fields_of_the_standard(spark):
    path = new_path(spark, "test")
    warc.write_warc(pages(spark, ROWS), path, segment=1000, date=datetime(2024, 5, 6, 7, 8, 9, tzinfo=UTC))
    text = b"".join(Path(p).read_bytes() for p in glob.glob(path.removeprefix("file://") + "/part-*"))
    heads = [warc.head_of(x)[0] for x in text.split(b"WARC/1.")[1:]]
    assert all({"warc-type", "warc-record-id", "warc-date", "content-length", "warc-target-uri"} <= h.keys() for h in heads)
    assert {h["warc-date"] for h in heads} == {"2024-05-06T07:08:09Z"} and all(h["warc-target-uri"] for h in heads)
    ids = [h["warc-record-id"] for h in heads]
    assert len(set(ids)) == len(ids) and all(i.startswith("<urn:uuid:") for i in ids)
    of = {h["warc-record-id"]: h for h in heads}
    revisits = [h for h in heads if h["warc-type"] == "revisit"]
    assert len(revisits) == 3  # page 2 and a null id revisit page 1, page 4 revisits page 3
    for h in revisits:
        origin = of[h["warc-refers-to"]]
        assert origin["warc-type"] == "response" and origin["x-page-id"] == h["x-refers-to-page-id"]
        assert origin["warc-payload-digest"] == h["warc-payload-digest"] and origin["warc-target-uri"] == h["warc-refers-to-target-uri"]
        assert h["warc-refers-to-date"] == origin["warc-date"] and h["warc-profile"].endswith("identical-payload-digest")


def foreign(version, kind, target, block, name, extra=""):
    """A record as another program writes it: fields in another order and case, some without a blank."""
    head = f"WARC/{version}\r\ncontent-length:{len(block)}\r\nWARC-Target-URI: {target}\r\nWARC-TYPE: {kind}\r\nWarc-Record-Id: <urn:uuid:{name}>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\n{extra}\r\n"
    return head.encode() + block + b"\r\n\r\n"


def test_archives_of_other_writers(spark, scratch, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    inner = foreign("1.1", "response", "http://inner/", http + b"inner", "i")
    body = b"WARC/1.0\r\nsaid WARC/1.1\r\nWARC/1." + inner * 3 + b"WARC/1.1\r\n\r\n"
    chunked = http.replace(b"X: y", b"Transfer-Encoding: chunked") + b"3\r\nabc\r\n0\r\n\r\n"
    digest = f"WARC-Payload-Digest: sha1:{warc.payload_digest(b'abc')}\r\n"
    old = [foreign("1.0", "warcinfo", "-", b"software: x\r\n", "w"), foreign("1.0", "response", "http://a/", http + body, "a"), foreign("1.0", "request", "http://a/", b"GET", "b")]
    new = [foreign("1.1", "response", "http://c/", chunked, "c", digest), foreign("1.1", "response", "http://d/", http + b"d" * 300_000, "d", "WARC-Payload-Digest: sha256:00\r\n folded\r\n")]
    new += [foreign("1.1", "response", "http://e/", http + b"WARC/1.", "e"), foreign("1.1", "response", "http://f/", http, "f")]
    (tmp_path / "old.warc").write_bytes(b"".join(old))
    (tmp_path / "new.warc.gz").write_bytes(b"".join(map(gzip.compress, new)))
    (tmp_path / "cut.warc").write_bytes(b"".join(old[1:] + new)[:-4])  # no line ends after the last record
    conf = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")  # records and inner marks lie across splits
    try:
        records = warc.read_foreign(spark, str(tmp_path), scratch)
        assert Counter(r.type for r in records.collect()) == {"warcinfo": 1, "request": 2, "response": 10}
        got = warc.pages_of(records, more=("target", "date")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", conf)
    want = {"http://a/": body, "http://c/": b"abc", "http://d/": b"d" * 300_000, "http://e/": b"WARC/1.", "http://f/": b""}
    assert sorted((r.target, bytes(r.html)) for r in got) == sorted([*want.items()] * 2)
    assert {r.date for r in got} == {"2020-01-01T00:00:00Z"} and all(r.payload_digest == warc.payload_digest(want[r.target]) for r in got)


def test_damaged_archives_of_other_writers(spark, scratch, tmp_path):
    whole = foreign("1.1", "response", "http://a/", b"HTTP/1.1 200 OK\r\n\r\nabc", "a")
    for k, bad in enumerate((whole[:-9], b"junk" + whole, whole + b"WARC/1.1\r\nno head\r\n", whole.replace(b"abc", b"abcde"))):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "x.warc").write_bytes(bad)
        with pytest.raises(Exception, match="bytes|no record"):
            warc.read_foreign(spark, str(tmp_path / f"{k}"), scratch).collect()
