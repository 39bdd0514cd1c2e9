import base64
import gzip
import hashlib

import pyarrow.fs as pafs
import pytest

from reuselens.llm import warc


def sha(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def brute(rows):
    first = {}
    for page, _, html in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    out = []
    for page, url, html in rows:
        f = first.get(html or "")
        again = page is not None and page > f
        out.append((page, url, len((html or "").encode()), sha(html), "revisit" if again else "response", f if again else None,
                    None if again else (html or "").encode()))
    return sorted(out, key=str)


def got(df):
    rows = df.collect()
    assert all(r.intact is (True if r.record_type == "response" else None) for r in rows)
    return sorted(((r.page_id, r.target_uri, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to,
                    None if r.payload is None else bytes(r.payload)) for r in rows), key=str)


def test_round_trip_of_a_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    path = warc.write_archive(pages.repartition(3))
    assert got(warc.read_archive(spark, path)) == brute(rows)
    store, folder = warc.open_fs(path)
    names = [f.base_name for f in store.get_file_info(pafs.FileSelector(folder)) if f.type == pafs.FileType.File]
    assert names and all(n.endswith(".warc.gz") for n in names)
    with store.open_input_stream(f"{folder}/{names[0]}", compression=None) as f:  # any gzip reader can read it
        assert gzip.decompress(f.read()).startswith(b"WARC/1.1\r\nWARC-Type: ")


def test_odd_rows(spark):
    big = "".join(f"<p>é{i}</p>" for i in range(300_000))
    rows = [(3, None, "same"), (2, "http://a/\r\nWARC-Type: x", "same"), (5, "http://b", None), (4, "", ""), (6, "u", big),
            (7, "u", big), (None, "v", "lone"), (None, "v", "same"), (8, "w", "\r\n\r\nWARC/1.1\r\n\r\n"), (2, "again", "same")]
    pages = spark.createDataFrame([(h, u, p, 1, "x") for p, u, h in rows],
                                  "html string, url string, page_id long, payload int, hex string")
    want = [(p, u and u.replace("\r\n", "%0D%0A"), *rest) for p, u, *rest in brute(rows)]
    read = warc.read_archive(spark, warc.write_archive(pages))
    assert got(read) == sorted(want, key=str)
    assert warc.read_archive(spark, warc.write_archive(pages.limit(0))).collect() == []


def test_filters_and_payloads_are_pushed(spark):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}/", f"text {i // 2}") for i in range(60)],
                                  "page_id long, url string, html string")
    path = warc.write_archive(pages)
    read = spark.read.format("warc").option("payload", "none").load(path)
    assert read.filter("record_type = 'revisit'").count() == 30
    assert read.filter("payload is not null").count() == 0
    some = spark.read.format("warc").option("payload", "all").option("partitionbytes", 1).load(path)
    for cond in ("target_uri = 'http://h1/'", "record_type in ('response', 'other')", "target_uri like 'http://h2%'",
                 "not (record_type = 'response')", "refers_to is null and http_length > 6", "refers_to <> 'x'"):
        all_rows = some.collect()
        names = {r.record_id for r in spark.createDataFrame(all_rows, some.schema).filter(cond).collect()}
        assert {r.record_id for r in some.filter(cond).collect()} == names and names


@pytest.mark.parametrize("sl", [True, False])
def test_unwanted_payloads_are_not_inflated(tmp_path, monkeypatch, sl):
    row = {"record_type": "response", "record_id": "urn:page:1", "date": None, "target_uri": "u", "http_length": None,
           "payload_digest": None, "refers_to": None}
    import random
    noise = random.Random(1).randbytes(3_000_000)
    member = warc.gzip_member if sl else gzip.compress
    file = tmp_path / "a.warc.gz"
    file.write_bytes(b"".join(member(warc.record(row | {"payload": noise, "record_id": f"urn:page:{i}"})) for i in range(3)))
    plain = tmp_path / "b.warc"
    plain.write_bytes(b"".join(warc.record(row | {"payload": b"abc", "record_id": f"urn:page:{i}"}) for i in range(3)))
    for path, size in ((file, len(noise)), (plain, 3)):
        read = []

        class Counting:
            def __init__(self, f):
                self.f = f

            def read(self, n):
                data = self.f.read(n)
                read.append(len(data))
                return data

            def __getattr__(self, name):
                return getattr(self.f, name)

        with pafs.LocalFileSystem().open_input_file(str(path)) as f:
            rows = list(warc.records(Counting(f), lambda r: False, lambda r: True))
        assert [r["record_id"] for r in rows] == [f"urn:page:{i}" for i in range(3)] and rows[0]["payload"] is None
        if sl or path == plain:
            assert sum(read) < 3 * 70_000
        with pafs.LocalFileSystem().open_input_file(str(path)) as f:
            assert [len(r["payload"]) for r in warc.records(f, lambda r: True, lambda r: True)] == [size] * 3


def plain(n, front=b"", payload=b"ok"):
    block = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n%s\r\n" % (len(payload), front) + payload
    return (b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <r%d>\r\nContent-Type: application/http\r\n"
            b"Content-Length: %d\r\n\r\n" % (n, len(block)) + block + b"\r\n\r\n")


def rows_of(data):
    import io
    return [(r["record_id"], r["payload"]) for r in warc.records(io.BytesIO(data), lambda r: True, lambda r: True)]


@pytest.mark.parametrize("data", [
    plain(1) + b"\r\n\r\n\r\n" + plain(2), b"\r\n" + plain(1) + plain(2).rstrip(b"\r\n"), plain(1) + b"\n" + plain(2) + b"\r\n" * 9,
    gzip.compress(plain(1)) + gzip.compress(b"") + gzip.compress(plain(2)), gzip.compress(b"") + gzip.compress(plain(1)) + gzip.compress(plain(2)),
    gzip.compress(plain(1)) + gzip.compress(b"\r\n\r\n") + gzip.compress(b"\r\n" + plain(2)),
    warc.gzip_member(plain(1)) + warc.gzip_member(b"") + warc.gzip_member(plain(2)) + gzip.compress(b""),

])
def test_blank_members_and_lines_lose_no_record(data):
    assert rows_of(data) == [("r1", b"ok"), ("r2", b"ok")]


def test_long_http_headers_and_blocks_without_any():
    long = b"X-Long: " + b"y" * 9000 + b"\r\n"
    assert rows_of(plain(1, long) + plain(2, long * 50)) == [("r1", b"ok"), ("r2", b"ok")]
    bare = b"WARC/1.0\r\nWARC-Record-ID: <r1>\r\nContent-Type: application/http\r\nContent-Length: 6\r\n\r\nabc\r\nd\r\n\r\n"
    assert rows_of(bare + plain(2)) == [("r1", b"abc\r\nd"), ("r2", b"ok")]


@pytest.mark.parametrize("data", [b"no archive", b"HTTP/1.1 200 OK\r\n\r\n", plain(1) + b"rest\r\n\r\n", plain(1) + b"WARC/1.0\r\nWARC-Type: x"])
def test_what_is_no_record_raises(data):
    with pytest.raises(ValueError):
        rows_of(data)


def test_endless_headers_raise(monkeypatch):
    monkeypatch.setattr(warc._until_blank_line, "__defaults__", (1 << 20, b""))
    with pytest.raises(ValueError, match="more than"):
        rows_of(plain(1, b"X: " + b"y" * (2 << 20) + b"\r\n"))
