import base64
import gzip
import hashlib
import random

import pytest

from epiloom.llm import warc as m

digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()


def brute(pages, least=0):
    """Rows of the pages' digest, by sorting payloads."""
    out = []
    for page, html in pages:
        b = (html or "").encode()
        same = [p for p, h in pages if (h or "") == (html or "")]
        first = max((p for p in same if p is not None), default=None)
        again = len(b) >= least and page != first
        out.append((page, len(b), digest(b), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def corpus(rng):
    pages = [(i, "".join(rng.choice(["é", "<p>", "\r\n\r\nWARC/1.1\r\n", "x", "\x00", "𝄞", "\n"]) for _ in range(rng.choice([1, 7, 100, 3000])))) for i in range(60)]
    pages += [(100 + i, rng.choice([pages[3][1], pages[4][1], "", None])) for i in range(60)]
    return [*pages, (None, pages[5][1]), (None, "alone"), (None, "alone"), (7, pages[7][1]), (7, pages[7][1]), (999, "0123456789abcdef" * 5000)]


@pytest.fixture
def pages(spark):
    rows = corpus(random.Random(6))
    df = spark.createDataFrame([(p, random.Random(repr(p)).choice(["http://a.b/ü", "http://x/\r\nWARC-Type: evil", None]), h) for p, h in rows], "page_id long, url string, html string")
    return rows, df.selectExpr("*", "page_id AS n", "html AS payload", "url AS block", "1 AS sha1")


@pytest.mark.parametrize("least, chunk, segment, per_file", [(0, 4096, 16384, 8192), (50, 7, 300, 5), (0, 1, 4000, 1)])
def test_round_trip(spark, tmp_path, pages, least, chunk, segment, per_file):
    rows, df = pages
    m.write_warc(df, f"{tmp_path}/a", least, chunk, segment, per_file)
    got = m.index(spark, f"{tmp_path}/a")
    assert got.filter("problem IS NOT NULL").count() == 0
    assert sorted([tuple(r)[:5] for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()], key=repr) == brute(rows, least)
    read = {(r.page, bytes(r.payload)) for r in m.read_warc(spark, f"{tmp_path}/a").selectExpr("cast(headers['x-page-id'] AS long) AS page", "payload").filter("payload IS NOT NULL").collect()}
    assert {h for _, h in read} == {(h or "").encode() for _, h in rows}
    found = m.read_records(spark, f"{tmp_path}/a")
    assert found.selectExpr("max(length(block))").first()[0] <= segment
    ids = [r[0] for r in found.selectExpr("headers['warc-record-id']").collect()]
    assert len(ids) == len(set(ids))
    most = max(r["count"] for r in found.groupBy("path").count().collect())
    assert most <= per_file


def test_hot_payloads_are_joined_by_broadcast_or_by_digest(spark, tmp_path):
    rows = [(i, "same" if i % 3 else f"own {i // 30}") for i in range(3000)]
    m.write_warc(spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'u' AS url"), f"{tmp_path}/a")
    got = m.index(spark, f"{tmp_path}/a").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_no_pages(spark, tmp_path):
    m.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), f"{tmp_path}/a")
    assert m.index(spark, f"{tmp_path}/a").count() == 0


def record(block, *lines):
    return "\r\n".join(["WARC/1.0", *lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def test_archives_of_others(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n3;x=y\r\nabc\r\n00\r\n\r\n"
    kind = "Content-Type: application/http;msgtype=response"
    part = lambda k, block, *more: record(block, f"WARC-Type: {'continuation' if k > 1 else 'response'}", f"WARC-Record-ID: <{k}>", f"WARC-Segment-Number: {k}", *(["WARC-Segment-Origin-ID: <1>"] if k > 1 else [kind]), *more)
    sound = [record(b"soft", "WARC-Type: warcinfo", "WARC-Record-ID: <i>", "X-Folded: a", "\tb"), record(http, "warc-type: response", "WARC-Record-ID: <r>", kind, f"WARC-Payload-Digest: sha1:{digest(b'abc')}"), part(3, http[40:], f"WARC-Segment-Total-Length: {len(http)}"), part(1, http[:9]), part(2, http[9:40])]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(gzip.compress, sound)))
    (tmp_path / "b.warc").write_bytes(b"".join(sound[:2]))
    rows = m.read_warc(spark, str(tmp_path)).collect()
    assert sorted(bytes(r.payload) for r in rows) == [b"abc", b"abc", b"abc", b"soft", b"soft"] and not any(r.problem for r in rows)
    assert {r.headers.get("x-folded") for r in rows} == {None, "a b"}


@pytest.mark.parametrize(
    "bad, problem",
    [
        ([record(b"x", "WARC-Type: continuation", "WARC-Record-ID: <2>", "WARC-Segment-Origin-ID: <1>", "WARC-Segment-Number: 2", "WARC-Segment-Total-Length: 1")], "segments missing or repeated"),
        ([record(b"x", "WARC-Type: resource", "WARC-Record-ID: <1>", "WARC-Segment-Number: 1")], "no total length"),
        ([record(b"x", "WARC-Type: resource", "WARC-Record-ID: <1>", "WARC-Segment-Number: 1", "WARC-Segment-Total-Length: 2")], "total length differs"),
        ([record(b"a\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nabc\r\n0\r\n\r\n", "WARC-Type: response", "Content-Type: application/http")], "broken chunks"),
        ([record(b"x", "WARC-Type: resource", f"WARC-Payload-Digest: sha1:{digest(b'y')}")], "digest differs"),
        ([record(b"x", "WARC-Type: resource")[:-5]], "cut short"),
        ([b"GARBAGE"], "no record"),
    ],
)
def test_problems_are_told(spark, tmp_path, bad, problem):
    good = record(b"fine", "WARC-Type: resource", "WARC-Record-ID: <f>")
    (tmp_path / "x.warc").write_bytes(b"".join([good, *bad]))
    assert sorted([r.problem for r in m.read_warc(spark, str(tmp_path)).collect()], key=str) == [None, problem]


def test_gzip_cut_short(spark, tmp_path):
    noise = random.Random(1).randbytes(3_000_000)
    (tmp_path / "x.warc.gz").write_bytes(gzip.compress(record(b"fine", "WARC-Type: resource")) + gzip.compress(record(noise, "WARC-Type: resource"))[:2_000_000])
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(record(noise, "WARC-Type: resource")))
    assert sorted([(r.problem, len(r.payload)) for r in m.read_warc(spark, str(tmp_path)).collect() if r.problem is None]) == [(None, 4), (None, 3_000_000)]
    assert m.read_warc(spark, str(tmp_path)).filter("problem = 'cut short'").count() == 1
