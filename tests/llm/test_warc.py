from __future__ import annotations

import base64
import gzip
import hashlib
import io
from pathlib import Path

from deltaloom.llm import warc
from deltaloom.llm.common import shared_folder

ROWS = [(1, "http://a/", "<p>é</p>", "x"), (2, "http://b/", "<p>é</p>", "x"), (3, None, None, "x"), (4, "u\r\nX: y", "", "x"), (5, "u", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n", "x"), (6, "u", "z" * 300_000, "x"), (None, "u", "<p>é</p>", "x"), (None, "u", "alone", "x"), (9, "u", "r", "x"), (9, "u", "r", "x")]


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, digest string")
    groups = {}
    for i, _, h, _ in ROWS:
        groups.setdefault(h or "", []).append(i)
    want = []
    for i, _, h, _ in ROWS:
        most = max((x for x in groups[h or ""] if x is not None), default=None)
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), digest, "response" if i == most else "revisit", None if i == most else most))
    got = [tuple(r)[:5] for r in warc.archived(pages).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_members_stand_alone(spark):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, x string").coalesce(1)
    source, target = shared_folder(spark), shared_folder(spark)
    files = warc.write_monoliths(pages, source)
    assert warc.normalise(files, source, target).agg({"records": "sum"}).first()[0] == len(ROWS)
    whole = {}
    for p in Path(source).glob("*.warc.gz"):
        assert len(list(warc.records(io.BytesIO(p.read_bytes()), 7))) > 0
        whole[p.name] = gzip.decompress(p.read_bytes())
    for p in Path(target).glob("*.warc.gz"):
        assert gzip.decompress(p.read_bytes()) == whole[p.name]
    for r in warc.index_of(spark, target).collect():
        data = Path(target, r.file).read_bytes()[r.position : r.position + r.bytes]
        fields, _ = warc.parsed(gzip.decompress(data))
        assert fields["WARC-Record-ID"] == r.record and fields["WARC-Type"] == r.kind
    assert not [p for p in Path(target).iterdir() if p.name.startswith("_")]


def test_empty(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
