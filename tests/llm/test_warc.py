"""WARC reading and revisit resolution against plain Python."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from growthcast.llm import queries as Q, warc as R


def made(seed, n=300):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        url = "http://hot.example/" if rng.random() < .4 else f"http://h.example/{rng.randrange(12)}"
        tag = rng.choice(['"a"', 'W/"a"', '"b"', None])
        headers = [("X-A", str(i))] + ([("ETag", tag)] if tag else []) + ([("Connection", "X-Hop")] if i % 3 else []) + [("X-Hop", "h"), ("Content-Length", "9")]
        if rng.random() < .5:
            out.append(("response", f"r{i:04}", url, rng.randrange(60), rng.choice([200, 200, 200, 404]), headers, f"body {i % 5}".encode()))
        else:
            out.append(("revisit", f"v{i:04}", url, rng.randrange(60), 304, headers, b""))
    return out


def low(headers):
    return {k.lower(): v for k, v in headers}


def brute(rows):
    out = []
    for kind, i, url, at, status, headers, body in rows:
        own = low(headers)
        before = [r for r in rows if r[0] == "response" and r[4] == 200 and r[2] == url and r[3] < at]
        if kind == "response":
            out.append((i, "stored", None, status, own, len(body)))
        elif not before:
            out.append((i, "unmatched", None, status, own, len(body)))
        else:
            s = max(before, key=lambda r: (r[3], r[1]))
            old = low(s[5])
            a, b = own.get("etag"), old.get("etag")
            if a and b and a.removeprefix("W/") != b.removeprefix("W/"):
                out.append((i, "mismatch", s[1], status, own, len(body)))
            else:
                listed = {x.strip().lower() for x in own.get("connection", "").split(",")}
                out.append((i, "resolved", s[1], s[4], old | {k: v for k, v in own.items() if k not in R.KEPT_STORED and k not in listed}, len(s[6])))
    return sorted(out, key=lambda r: r[0])


def captures(spark, contents, **how):
    df = spark.createDataFrame([(c, "clash") for c in contents], "content binary, canonical string")
    return R.records(df, **how)


@pytest.mark.parametrize("bucket", [R.BUCKET, 4])
def test_against_python(spark, bucket):
    rows = made(bucket)
    contents = [b"".join(R.record_bytes(*r) for r in rows[:100]), gzip.compress(b"".join(R.record_bytes(*r) for r in rows[100:200])), *(R.record_bytes(*r) for r in rows[200:])]
    got = R.resolve(captures(spark, contents), bucket).collect()
    assert sorted(((r.record_id, r.outcome, r.source_id, r.status, r.headers, r.payload_bytes) for r in got), key=lambda r: r[0]) == brute(rows)


def test_edges(spark):
    ok = R.record_bytes("response", "a", "HTTP://H.example:80/x/../y?utm_source=f&b=2&a=1#z", 10, 200, [("Last-Modified", "m")], b"B" * 300_000)
    contents = [None, b"", b"junk", ok + b"WARC/1.1\r\nContent-Length: 999\r\n\r\nshort", ok.replace(b"WARC-Target-URI: HTTP", b"X: HTTP"), ok.replace(b"WARC-Date: ", b"WARC-Date: x"),
                R.record_bytes("revisit", "b", "http://h.example/y?a=1&b=2", 20, 304, [("Last-Modified", "m")], b""), R.record_bytes("revisit", "c", "http://h.example/y?a=1&b=2", 10, 304, [], b""),
                R.record_bytes("revisit", "d", "http://h.example/y?a=1&b=2", 30, 304, [("Last-Modified", "n")], b""), R.record_bytes("revisit", "e", "", 30, 304, [], b""),
                R.record_bytes("revisit", "f", "http://h.example/y?a=1&b=2", 30, 304, [], b"", "sha1:OTHER"), R.record_bytes("metadata", "g", "http://h.example/", 1, 200, [], b"")]
    caps = captures(spark, contents, bodies=True)
    got = {r.record_id: r for r in R.with_bodies(R.resolve(caps).where("kind = 'revisit'"), caps).collect()}
    assert {k: r.outcome for k, r in got.items()} == {"b": "resolved", "c": "unmatched", "d": "mismatch", "e": "unmatched", "f": "resolved"}
    assert len(got["b"].body) == 300_000 and got["d"].body == b"" and got["b"].canonical == "http://h.example/y?a=1&b=2"
    assert R.resolve(caps).count() == 8
    assert R.resolve(captures(spark, [])).count() == 0


def test_canonical_urls():
    same = ["http://a.example/x%7Ey/?q=1&utm_medium=z", "HTTP://A.example:80/./x~y?q=1#f", "http://u:p@a.example//x~y?q=1&ref=k"]
    assert {R.canonical_url(u) for u in same} == {"http://a.example/x~y?q=1"}
    assert [R.canonical_url(u) for u in (None, "", "mailto:x", "http://", "http://h:port/")] == [None] * 5


def test_query_has_two_rows_a_page(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = Q.QUERIES["op9_warc_revisits"](spark, sf).collect()
    assert len(rows) == 2 * len(pages)
    full = {r.record_id: r for r in rows if r.kind == "response"}
    for r in rows:
        if r.outcome == "resolved":
            page = int(r.source_id.split(":")[2])
            assert r.payload_sha256 == full[r.source_id].payload_sha256 and r.status == 200 and R.canonical_url(pages[page].url) == r.canonical
            assert json.loads(r.headers)["cache-control"] == "max-age=600" and "x-hop" not in json.loads(r.headers)
    by_page = {int(r.record_id.split(":")[2]): r.outcome for r in rows if r.kind == "revisit"}
    assert {by_page[i] for i in pages if i % 4 == 3} == {"mismatch"} and "resolved" in by_page.values()


def test_cut_and_broken_members(spark):
    whole = [R.record_bytes("response", f"r{i}", "http://h.example/", i, 200, [], random.Random(i).randbytes(200_000)) for i in range(3)]
    members = [gzip.compress(r) for r in whole]
    broken = members[1][:40] + b"\xff" * 40 + members[1][80:]
    contents = [members[0] + members[1][:-50_000], members[0] + broken + members[2], b"".join(members) + b"\0" * 20, gzip.compress(b"".join(whole))[:-1000], whole[0] + whole[1][:-9]]
    got = [sorted(r.record_id for r in captures(spark, [c]).collect()) for c in contents]
    assert got == [["r0"], ["r0"], ["r0", "r1", "r2"], ["r0", "r1"], ["r0"]]
