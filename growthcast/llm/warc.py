"""WARC records and the resolution of "not modified" revisits.

``records`` reads WARC bytes (plain or gzip, any number of records in a row) into
one row for each response and revisit, with HTTP status, headers, validators and
the payload's digest. ``resolve`` joins every revisit as of its date to the
latest earlier full response (status 200) of the same canonical URL, checks the
validators, and merges the headers that a 304 may update into the stored ones.

The as-of join is two running maxima: captures of a URL are cut into buckets of
equal time spans, about ``BUCKET`` captures each; the last response of earlier
buckets is carried along the buckets, and inside a bucket a window gives the
last response before each revisit. So a URL with very many captures is spread
over many tasks. Only metadata is moved; ``with_bodies`` joins payloads by record.

A revisit is ``resolved`` if an earlier response exists and no validator
disagrees; ``mismatch`` if an entity tag (compared weakly), a date of last
modification or a payload digest that both have differs; ``unmatched`` if there is
no earlier response. Full responses are ``stored``.

Nulls and edge cases: null or empty bytes give no record; a broken or cut record
or gzip member ends the reading of its bytes, and the whole records before it
stay; records without a URL or a date are never joined; a
response of the same second is not earlier; of equal dates the greater record
id counts as later; repeated records stay repeated; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import parse_qsl, quote, unquote_to_bytes, urlencode, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from growthcast.session import materialise

BUCKET = 10_000
#: Bytes inflated at a time.
PIECE = 1 << 16
START, END = re.compile(rb"\s*WARC/\d\.\d\r?\n"), re.compile(rb"\r?\n\r?\n")
#: Fields of a 304 that never replace stored ones: they are about the connection or the body that isn't sent.
KEPT_STORED = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate",
               "proxy-authorization", "proxy-connection", "set-cookie", "te", "trailer", "transfer-encoding", "upgrade")
#: Query parameters that tell where a visit came from, not which page it is.
TRACKING = re.compile(r"utm_\w+|gclid|fbclid|msclkid|ref|sessionid|phpsessid|jsessionid", re.I)
PORTS = {"http": 80, "https": 443}

META = ("record_id string, kind string, url string, canonical string, at long, status int, headers map<string,string>, "
        "etag string, modified string, digest string, payload_sha256 string, payload_bytes long")


def canonical_url(url: str | None) -> str | None:
    """Scheme and host in lower case without default port, user or fragment; dot segments resolved, escapes normal, tracking parameters gone, the others sorted."""
    if not url:
        return None
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return None
    scheme = parts.scheme.lower()
    if scheme not in PORTS or not host:
        return None
    path: list[str] = []
    for piece in parts.path.split("/"):
        if piece == "..":
            path = path[:-1]
        elif piece not in (".", ""):
            path.append(quote(unquote_to_bytes(piece), safe="!$&'()*+,;=:@~"))
    query = sorted((k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not TRACKING.fullmatch(k))
    return (f"{scheme}://{host}" + (f":{port}" if port not in (None, PORTS[scheme]) else "") + "/" + "/".join(path)
            + ("?" + urlencode(query) if query else ""))


def record_bytes(kind: str, record_id: str, url: str, at: int, status: int, headers: list[tuple[str, str]], body: bytes, digest: str | None = None) -> bytes:
    """One WARC record around an HTTP response."""
    date = datetime.fromtimestamp(at, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = f"HTTP/1.1 {status} -\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    block = http.encode() + body
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Target-URI", url), ("WARC-Date", date)]
    fields += [("WARC-Payload-Digest", digest)] if digest else []
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; of repeated ones the values joined, continued lines unfolded."""
    out: dict[str, str] = {}
    for line in re.sub(rb"\r?\n[ \t]+", b" ", head).split(b"\n"):
        name, colon, value = line.decode("utf-8", "replace").strip().partition(":")
        if colon:
            key = name.strip().lower()
            out[key] = f"{out[key]}, {value.strip()}" if key in out else value.strip()
    return out


def _pieces(data: bytes) -> Iterator[bytes]:
    """The bytes, inflated member by member up to the first broken one."""
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    at, member = 0, zlib.decompressobj(31)
    while at < len(data):
        piece = data[at:at + PIECE]
        try:
            yield member.decompress(piece)
        except zlib.error:
            return
        at += len(piece) - len(member.unused_data)
        if member.eof:
            member = zlib.decompressobj(31)


def parse_records(data: bytes | None) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each whole record; stops at bytes that aren't one. Holds one record and a piece."""
    pieces, held, need = _pieces(data or b""), bytearray(), 1
    while True:
        while len(held) < need and (piece := next(pieces, None)) is not None:
            held += piece
        if len(held) < need:
            return
        start = START.match(held)
        if not start and len(held[:64].lstrip()) >= 16:
            return
        end = start and END.search(held, start.end() - 1)
        if not end:
            need = len(held) + 1
            continue
        fields, first = _fields(bytes(held[start.end():end.start()])), end.end()
        try:
            length = int(fields.get("content-length", ""))
        except ValueError:
            return
        if length < 0:
            return
        while len(held) < first + length and (piece := next(pieces, None)) is not None:
            held += piece
        if len(held) < first + length:
            return
        yield fields, bytes(held[first:first + length])
        del held[:first + length]
        need = 1


def records(files: DataFrame, content: str = "content", bodies: bool = False) -> DataFrame:
    """One row for each response and revisit in the column's bytes; with ``bodies`` also the payload."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [row for x in batch.column(0) for row in _rows(x.as_py(), bodies)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    s, n = pa.string(), pa.int64()
    schema = pa.schema([("record_id", s), ("kind", s), ("url", s), ("canonical", s), ("at", n), ("status", pa.int32()), ("headers", pa.map_(s, s)),
                        ("etag", s), ("modified", s), ("digest", s), ("payload_sha256", s), ("payload_bytes", n)] + [("body", pa.binary())] * bodies)
    return files.select(content).mapInArrow(run, META + ", body binary" * bodies)


def _rows(data: bytes | None, bodies: bool) -> Iterator[dict]:
    for fields, block in parse_records(data):
        kind = fields.get("warc-type", "").lower()
        if kind not in ("response", "revisit"):
            continue
        cut = re.search(rb"\r?\n\r?\n", block)
        head, body = (block[:cut.start()], block[cut.end():]) if cut else (block, b"")
        first = re.match(rb"HTTP/\S+\s+(\d{3})", head)
        headers = _fields(head.partition(b"\n")[2])
        try:
            at = int(datetime.fromisoformat(fields["warc-date"].replace("Z", "+00:00")).timestamp())
        except (KeyError, ValueError):
            at = None
        url = fields.get("warc-target-uri", "").strip("<>") or None
        yield {"record_id": fields.get("warc-record-id", "").strip("<>") or None, "kind": kind, "url": url, "canonical": canonical_url(url), "at": at,
               "status": int(first[1]) if first else None, "headers": list(headers.items()), "etag": headers.get("etag"), "modified": headers.get("last-modified"),
               "digest": fields.get("warc-payload-digest"), "payload_sha256": hashlib.sha256(body).hexdigest(), "payload_bytes": len(body)} | ({"body": body} if bodies else {})


def resolve(captures: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Rows of ``records`` -> record_id, kind, canonical, at, outcome, source_id, status, headers, payload_sha256, payload_bytes.

    Resolved revisits have status, merged headers and payload of their source;
    the others keep their own.
    """
    # read several times below, and dear to make
    known = materialise(captures.select(*[c.split()[0] for c in META.split(", ")]), "captures")
    joinable = F.col("canonical").isNotNull() & F.col("at").isNotNull()
    full = joinable & (F.col("kind") == "response") & (F.col("status") == 200)
    stored = F.struct("at", "record_id", "status", "headers", "etag", "modified", "digest", "payload_sha256", "payload_bytes")
    # maps can't be ordered, so the latest is chosen by (at, record_id)
    latest = lambda c: F.max_by(c, F.struct(c["at"], c["record_id"]))
    rows = known.withColumn("full", F.when(full, stored))
    spans = (known.where(joinable).groupBy("canonical").agg(
        F.min("at").alias("_from"), F.max("at").alias("_to"), F.ceil(F.count("*") / bucket).alias("_n")))
    placed = (rows.join(spans, "canonical", "left")
              .withColumn("_b", F.floor((F.col("at") - F.col("_from")) * F.col("_n") / (F.col("_to") - F.col("_from") + 1))))
    lasts = placed.where("full IS NOT NULL").groupBy("canonical", "_b").agg(latest(F.col("full")).alias("_last"))
    buckets = placed.where("kind = 'revisit'").select("canonical", "_b").distinct().join(lasts, ["canonical", "_b"], "full")
    earlier = W.partitionBy("canonical").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    carried = buckets.withColumn("_carried", F.last("_last", True).over(earlier)).select(
        F.col("canonical").alias("_c"), F.col("_b").alias("_b2"), "_carried")
    # in order of (at, record_id) the last response in an earlier second; nulls are alone in their group and never joined
    before = W.partitionBy("canonical", "_b").orderBy("at").rangeBetween(W.unboundedPreceding, -1)
    inside = placed.where(joinable).withColumn("_inside", latest(F.col("full")).over(before))
    found = (inside.join(carried, (F.col("canonical") == F.col("_c")) & (F.col("_b") == F.col("_b2")), "left")
             .withColumn("source", F.when(F.col("kind") == "revisit", F.coalesce("_inside", "_carried"))))
    cols = [*known.columns, "source"]
    apart = rows.where(~joinable | joinable.isNull()).withColumn("source", F.lit(None).cast(found.schema["source"].dataType))
    return _merged(found.select(cols).union(apart.select(cols)))


def _merged(rows: DataFrame) -> DataFrame:
    weak = lambda c: F.regexp_replace(c, "^W/", "")
    src = lambda c: F.col(f"source.{c}")
    differ = lambda a, b: F.coalesce(a != b, F.lit(False))
    mismatch = (differ(weak(F.col("etag")), weak(src("etag"))) | differ(F.col("modified"), src("modified"))
                | differ(F.lower("digest"), F.lower(src("digest"))))
    outcome = (F.when(F.col("kind") != "revisit", "stored").when(F.col("source").isNull(), "unmatched")
               .when(mismatch, "mismatch").otherwise("resolved"))
    resolved = F.col("outcome") == "resolved"
    # names that the 304's Connection field lists stay with the connection too
    listed = F.transform(F.split(F.lower(F.coalesce(F.element_at("headers", "connection"), F.lit(""))), ","), lambda x: F.trim(x))
    hop = F.array(*[F.lit(n) for n in KEPT_STORED])
    update = F.map_filter("headers", lambda k, v: ~F.array_contains(hop, k) & ~F.array_contains(listed, k))
    old = F.map_filter(src("headers"), lambda k, v: ~F.map_contains_key(update, k))
    take = lambda c, own: F.when(resolved, src(c)).otherwise(own)
    return rows.withColumn("outcome", outcome).select(
        "record_id", "kind", "canonical", "at", "outcome", F.when(F.col("outcome").isin("resolved", "mismatch"), src("record_id")).alias("source_id"),
        take("status", F.col("status")).alias("status"), F.when(resolved, F.map_concat(old, update)).otherwise(F.col("headers")).alias("headers"),
        take("payload_sha256", F.col("payload_sha256")).alias("payload_sha256"), take("payload_bytes", F.col("payload_bytes")).alias("payload_bytes"))


def with_bodies(resolved: DataFrame, captures: DataFrame) -> DataFrame:
    """Adds ``body`` from ``records(..., bodies=True)``: of the source for resolved revisits, else the record's own."""
    bodies = captures.select(F.col("record_id").alias("_id"), "body").dropDuplicates(["_id"])
    wanted = F.when(F.col("outcome") == "resolved", F.col("source_id")).otherwise(F.col("record_id"))
    return resolved.withColumn("_want", wanted).join(bodies, F.col("_want") == F.col("_id"), "left").drop("_want", "_id")


def sorted_json(headers: Column) -> Column:
    """A map as JSON text with its names in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(headers))))


def captures_of_pages(pages: DataFrame) -> DataFrame:
    """(content): WARC bytes with two captures of every page: a full response, and a day or more later a revisit.

    Three of four revisits carry the entity tag of the page, the others one of
    another version. Dates follow the id.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                body, n = (html or "").encode(), page_id or 0
                digest, at = hashlib.sha256(body).hexdigest(), 1_704_067_200 + n % 1_000_000 * 60
                tag, date = f'"{digest[:16]}"', datetime.fromtimestamp(at, timezone.utc).strftime("%a, %d %b %Y %H:%M:%S GMT")
                first = record_bytes("response", f"urn:page:{page_id}:full", url or "", at, 200, [
                    ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(body))), ("ETag", tag), ("Last-Modified", date),
                    ("Cache-Control", "max-age=60"), ("X-Page", str(page_id))], body, f"sha256:{digest}")
                later = at + 86_400 + n % 7 * 3_600
                again = record_bytes("revisit", f"urn:page:{page_id}:again", url or "", later, 304, [
                    ("ETag", "W/" + tag if n % 4 != 3 else '"other"'), ("Cache-Control", "max-age=600"), ("Content-Length", "0"),
                    ("Connection", "close, X-Hop"), ("X-Hop", "1"), ("X-Seen", str(later))], b"")
                out.append(first + again)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["content"])
    return pages.select("page_id", "url", "html").mapInArrow(run, "content binary")
