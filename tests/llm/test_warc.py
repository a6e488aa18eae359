import hashlib

import pytest

from quarry.llm import common, warc

BIG = "<p>é" * 400
FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (9, "http://a/\r\n9", BIG), (3, None, "small"), (4, "u", "small"), (5, "u", None),
    (6, "u", FAKE * 3 + BIG), (7, "u", "x\r\n\r\n" + FAKE + "tail\r\n\r\n"), (8, "u", "WARC/1.1\r\n" * 50), (None, "u", "no id"), (10, "u", ""),
    (11, "u", "z" * 300_000),
]


def expected(pages):
    out = []
    for i, _, html in pages:
        data = (html or "").encode()
        same = [j for j, _, h in pages if (h or "").encode() == data and j is not None]
        again = len(data) >= 1000 and same and i != max(same)
        out.append((i or -1, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk", [warc.CHUNK, 700, 64])
def test_what_is_written_is_read_back(spark, monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    pages = spark.createDataFrame([(*p, "clash", 1) for p in PAGES], "page_id long, url string, html string, payload string, size int")
    pages = pages.coalesce(1) if chunk == 700 else pages
    got = warc.query(pages).collect()
    assert sorted(((r.page_id or -1, *r[1:]) for r in got), key=str) == expected(PAGES)


def test_payloads_and_urls(spark):
    folder = common.new_folder(spark, "warc-test")
    warc.write(spark.createDataFrame(PAGES, "page_id long, url string, html string"), folder)
    got = {r.page_id: r for r in warc.read(spark, folder).collect()}
    assert 666 not in got and got[6].payload == FAKE * 3 + BIG and got[9].url == "http://a/%0D%0A9" and got[3].url is None
    assert got[1].record_type == "revisit" and got[1].refers_to == 9 and got[9].payload == BIG


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "u", BIG), (1, "u", BIG), (2, "u", BIG), (2, "u", BIG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.record_type, r.refers_to) for r in warc.query(pages).collect())
    assert got == [(1, "revisit", 2)] * 2 + [(2, "response", None)] * 2
    assert warc.query(pages.limit(0)).count() == 0


def test_candidates_inside_payloads_do_not_reach_the_end():
    record = lambda body: f"WARC/1.1\r\nContent-Length: {len(body)}\r\n\r\n{body}\r\n\r\n"
    inner = record("x")
    data = (record("a" + inner + "b") + record("c")).encode()
    found = dict(warc.candidates(data, 0, len(data), len(data)))
    assert 0 in found and data.index(b"WARC", 1) not in found and found[0] == len(data)


@pytest.mark.parametrize("chunk", [warc.CHUNK, 70_000])
def test_headers_of_any_length(spark, monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    long = "http://a/" + "x" * 100_000
    pages = [(1, "u", "first"), (2, long, "second"), (3, "u", "third" + "WARC/1.1\r\na: b" * 9), (4, long + "y" * 1_000_000, BIG), (5, "u" * 70_000, "5")]
    folder = common.new_folder(spark, "warc-test")
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), folder)
    got = {r.page_id: (r.url, r.payload) for r in warc.read(spark, folder).collect()}
    assert got == {i: (u, h) for i, u, h in pages}


@pytest.mark.parametrize("tail", ["cut", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 900\r\n\r\ntruncated", "WARC/1.1\r\nno end of header"])
def test_a_broken_chain_is_an_error(spark, tmp_path, tail):
    record = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    (tmp_path / "a.warc").write_bytes((record + tail).encode())
    with pytest.raises(ValueError):
        warc.read(spark, f"file://{tmp_path}").collect()


def test_a_file_is_read_forward_once(tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "AHEAD", 100)
    data = bytes(range(256)) * 20
    (tmp_path / "f").write_bytes(data)
    reads = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def size(self):
            return self.f.size()

        def read_at(self, n, at):
            reads.append((at, n))
            return self.f.read_at(n, at)

    with warc.open_file(str(tmp_path / "f")) as f:
        s, at = warc.Stream(Counted(f)), 7
        while at < len(data):
            start = s.need(at, 37)
            assert s.data[start : start + 37] == data[at : at + 37]
            at += 37
    assert all(a + n == b for (a, n), (b, _) in zip(reads, reads[1:])) and sum(n for _, n in reads) == len(data) - 7


def test_archives_of_others(spark, tmp_path):
    """Other types and ids, version 1.0, base 32, and a revisit without a length."""
    import base64

    def record(version, headers, block):
        head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
        return f"WARC/{version}\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    body = b"<p>\xff WARC/1.1\r\n fake \r\n\r\n</p>"
    sha = hashlib.sha1(body).digest()
    uuid = "<urn:uuid:00000000-0000-0000-0000-000000000001>"
    data = record("1.0", {"WARC-Type": "warcinfo", "WARC-Record-ID": uuid}, b"software: x\r\n")
    data += record("1.1", {"WARC-Type": "request", "WARC-Record-ID": uuid, "WARC-Target-URI": "http://a/"}, b"GET / HTTP/1.1\r\n\r\n")
    data += record("1.1", {"WARC-Type": "response", "WARC-Record-ID": uuid, "WARC-Target-URI": "http://a/", "WARC-Payload-Digest": f"sha1:{base64.b32encode(sha).decode()}"}, b"HTTP/1.1 200 OK\r\n\r\n" + body)
    data += record("1.1", {"WARC-Type": "revisit", "WARC-Record-ID": "<urn:page:7>", "WARC-Refers-To": uuid, "WARC-Payload-Digest": f"sha1:{sha.hex()}"}, b"HTTP/1.1 200 OK\r\n\r\n")
    data += record("1.1", {"WARC-Type": "metadata", "WARC-Record-ID": uuid}, b"")
    (tmp_path / "w").mkdir()
    (tmp_path / "w/a.warc").write_bytes(data)
    got = [tuple(r) for r in warc.read(spark, f"file://{tmp_path}/w").collect()]
    assert [(r[0], r[2], r[3], r[4]) for r in got] == [(None, "warcinfo", None, 13), (None, "request", None, 18), (None, "response", None, len(body)), (7, "revisit", None, None), (None, "metadata", None, 0)]
    assert got[2][5] == got[3][5] == sha.hex() and got[2][6] == body.decode("utf-8", "replace") and got[2][1] == "http://a/"
