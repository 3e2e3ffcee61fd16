import base64
import gzip
import hashlib
import io
import json
import zipfile

import pytest

from sparkloom.llm import warc
from sparkloom.llm.common import new_path

SCHEMA = "page_id long, url string, html string, record_type string"


def test_round_trip_and_revisits(spark):
    rows = [(1, "http://a b/", "<p>x</p>", "?"), (2, None, "<p>x</p>", "?"), (3, "u", None, None), (4, "u", "", None), (5, "é", "é" * 70000, None), (None, "n", "<p>x</p>", None), (6, "u", "solo\r\n\r\nWARC/1.1\r\n\r\n", None)]
    pages = spark.createDataFrame(rows, SCHEMA)
    got = {r.page_id: r for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert len(got) == 7
    for page_id, _, html, _ in rows:
        body = (html or "").encode()
        r = got[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.digest(body))
        if r.record_type == "response":
            assert bytes(r.payload) == body and r.refers_to is None
    assert {i: r.refers_to for i, r in got.items()} == {1: 2, 2: None, 3: 4, 4: None, 5: None, None: 2, 6: None}
    short = {r.page_id: r.record_type for r in warc.read_archives(warc.write_archives(pages, least=1)).collect()}
    assert short[3] == short[4] == "response" and short[1] == "revisit"


def test_empty_and_repeated(spark):
    assert warc.read_archives(warc.write_archives(spark.createDataFrame([], SCHEMA))).count() == 0
    twice = spark.createDataFrame([(1, "u", "x", ""), (1, "u", "x", "")], SCHEMA)
    assert [r.record_type for r in warc.read_archives(warc.write_archives(twice)).collect()] == ["response"] * 2


@pytest.mark.parametrize("zip64", [False, True])
def test_packages_are_zip_files(spark, zip64):
    folder = new_path(spark, "zip")
    store, path = warc.open_store(folder)
    store.create_dir(path, recursive=True)
    records = [(i, warc.record(i, f"u{i}", b"body %d" % i, None)) for i in range(50)]
    assert warc.write_package(f"{folder}/a.wacz", iter(records), zip64) == 50
    with store.open_input_file(f"{path}/a.wacz") as f:
        data = f.read()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX]
    with warc.Package(f"{folder}/a.wacz") as p:
        found = {i: warc.parse_record(gzip.decompress(p.read(at, n))) for i, (at, n) in enumerate(p.index())}
    assert {i: x["payload"] for i, x in found.items()} == {i: b"body %d" % i for i in range(50)}
    # What zipfile writes, with a comment at its end, can be read too.
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("x", b"hello")
        z.comment = b"PK\x05\x06 not the end"
    with store.open_output_stream(f"{path}/b.zip") as f:
        f.write(out.getvalue())
    with warc.Package(f"{folder}/b.zip") as p:
        assert p.read(*p.place("x")) == b"hello"
    with store.open_output_stream(f"{path}/c.zip") as f:
        f.write(b"nothing like it")
    with pytest.raises(ValueError):
        warc.Package(f"{folder}/c.zip")


def brute(pages, least=0):
    """payload_bytes, payload_digest, record_type, refers_to of each page."""
    last = {}
    for i, html in pages:
        body = (html or "").encode()
        last[body] = max(last.get(body, i), i)
    out = {}
    for i, html in pages:
        body = (html or "").encode()
        of = last[body] if len(body) >= least else i
        out[i] = (len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if of == i else "revisit", None if of == i else of)
    return out


def test_query_over_a_table(spark):
    pages = [(r.page_id, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.op3_warc(spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(pages)


@pytest.mark.parametrize("shuffled", [False, True])
def test_revisits_of_a_table_with_equal_payloads(spark, monkeypatch, shuffled):
    if shuffled:
        monkeypatch.setattr(warc, "small_enough", lambda df: df)
        monkeypatch.setattr(warc, "hub_limit", lambda n: 20)
    first = [(r.page_id, r.html) for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()]
    pages = first + [(1000 + i, html) for i, html in first[:30]] + [(2000 + i, "" if i % 2 else None) for i in range(30)]
    rows = spark.createDataFrame([(i, "u", html) for i, html in pages], "page_id long, url string, html string")
    for least in (0, 10):
        got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(rows, least)).collect()}
        assert got == brute(pages, least)


def test_package_of_another_producer(spark):
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 4\r\n\r\nx: y\r\n\r\n"
    said = lambda n: warc.record(n, f"http://h/{n}", b"body %d" % n, None).replace(b"urn:page:", b"urn:uuid:")
    archives = {"archive/a.warc.gz": [gzip.compress(info), gzip.compress(said(1)), gzip.compress(said(2))], "archive/b.warc": [said(3)]}
    index = []
    for name, records in archives.items():
        at = 0
        for r in records:
            index.append(f'h)/{at} 20200101000000 {json.dumps({"url": "u", "filename": name[8:], "offset": str(at), "length": str(len(r))})}')
            at += len(r)
    folder = new_path(spark, "other")
    store, path = warc.open_store(folder)
    store.create_dir(path, recursive=True)
    for compressed in (False, True):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            z.writestr("datapackage.json", "{}")
            for name, records in archives.items():
                z.writestr(name, b"".join(records))
            text = "\n".join(index).encode()
            z.writestr("indexes/index.cdx.gz" if compressed else "indexes/index.cdxj", gzip.compress(text) if compressed else text, zipfile.ZIP_STORED if compressed else zipfile.ZIP_DEFLATED)
        with store.open_output_stream(f"{path}/{compressed}.wacz") as f:
            f.write(out.getvalue())
        got = warc.read_archives(spark.createDataFrame([(f"{folder}/{compressed}.wacz",)], "address string")).collect()
        assert sorted((r.url, bytes(r.payload), r.page_id, r.record_type) for r in got) == [(f"http://h/{n}", b"body %d" % n, None, "response") for n in (1, 2, 3)]
