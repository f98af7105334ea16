import base64
import glob
import gzip
import hashlib

from envspark.llm import warc as M


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def test_round_trip(spark, tmp_path):
    rows = [(5, "http://a/b?c#d", "<p>é\r\n\r\nWARC/1.1\r\n</p>"), (3, "https://x.org", "same"), (9, None, "same"), (2, "u v\r\nw", None),
            (7, "http://q/", ""), (None, "http://n/", "same"), (None, None, "only null id"), (4, "http://z", "tail\r\n\r\n"),
            (3, "https://x.org", "same"), (11, "http://big", "x" * 3_000_000 + "\r\n"), (12, "http://big", "y" * 10)]
    rows += [(100 + i, f"http://s{i}/", "hot") for i in range(50)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = str(tmp_path / "warc")
    out = M.warc_roundtrip(df, path).collect()
    first = {}
    for p, _, h in rows:
        if p is not None:
            first[h or ""] = min(first.get(h or "", p), p)
    got = sorted(((r.metadata.page_id, r.response.payload_bytes, r.response.payload_digest, r.response.type, r.response.refers_to) for r in out), key=repr)
    want = []
    for p, _, h in rows:
        again = (h or "") in first and p != first[h or ""]
        want.append((p, len((h or "").encode()), digest(h), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == sorted(want, key=repr)
    for r in out:
        assert r.request.http_head.startswith("GET ") and r.request.record_id and r.response.digest_ok in (True, None)
        if r.response.type == "response":
            assert digest(bytes(r.response.payload).decode()) == r.response.payload_digest
    raw = b"".join(gzip.open(f).read() for f in glob.glob(path + "/*.gz"))
    assert raw.count(b"WARC-Type: ") == 3 * len(rows) and raw.endswith(b"\r\n\r\n")


def test_files_follow_the_bytes(spark, tmp_path, monkeypatch):
    """Long pages get as many files as their bytes fill, whatever their number;
    a page longer than a file comes back whole; copies of one payload spread."""
    monkeypatch.setattr(M, "FILE_BYTES", 1 << 20)
    pages = [(i, f"http://l{i}/", chr(97 + i % 26) * (100_000 + i)) for i in range(100)]
    pages += [(1000, "http://huge/", "é" * 3_000_000)] + [(2000 + i, "http://c/", "copy " * 20_000) for i in range(60)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(1)
    path = str(tmp_path / "w")
    out = {r.metadata.page_id: r.response for r in M.warc_roundtrip(df, path).collect()}
    for p, _, h in pages:
        assert out[p].payload_bytes == len(h.encode()) and out[p].payload_digest == digest(h)
        assert (out[p].type, out[p].refers_to) == (("revisit", 2000) if p > 2000 else ("response", None))
    assert bytes(out[1000].payload).decode() == pages[100][2]
    held = [[r for r in M.parse_records(open(f, "rb").read()) if r["payload"]] for f in glob.glob(path + "/*.gz")]
    small = [sum(r["length"] for r in recs if r["length"] < 1 << 20) for recs in held]
    assert len(held) > 15 and max(small) < 3 << 20
    assert M.file_count(0, 4) == 4 and M.file_count(10 << 20, 4) == 10


def test_parser_reads_plain_and_record_wise_gzip():
    recs = [M._record("response", "1", "HTTP/1.1 200 OK\r\n\r\nbody", "application/http", WARC_Payload_Digest=f"sha1:{digest('body')}"),
            M._record("metadata", "2", "page-id: 4\r\n", "application/warc-fields", WARC_Concurrent_To="<urn:uuid:1>")]
    plain = b"".join((r + "\r\n\r\n").encode() for r in recs)
    members = b"".join(gzip.compress((r + "\r\n\r\n").encode()) for r in recs)
    a, b = list(M.parse_records(plain)), list(M.parse_records(members))
    assert a == b and [x["type"] for x in a] == ["response", "metadata"]
    assert a[0]["payload"] == b"body" and a[0]["digest_ok"] and a[1]["page_id"] == 4


def test_empty(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert M.warc_roundtrip(df, str(tmp_path / "w")).count() == 0
