"""WARC archives: written from pages, read back, and assembled into one nested row per capture.

A capture is written as three records: the response (or, for a payload that is already archived, a revisit
without payload that refers to it), the request and the metadata; the last two name the first in
WARC-Concurrent-To.  Reading makes no such assumption: any record may name any others, in chains too.
Each record is a gzip member of its own, as the format asks for."""
from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FileWriter, integral, key_of, map_arrow, materialize, new_path, open_input
from .graph import components

DATE = "2026-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads with fewer bytes are archived each.
LEAST_BYTES = 100
FILE_BYTES = 256 << 20


def record_id(capture: str, kind: str) -> str:
    digest = hashlib.sha256(f"{kind} {capture}".encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=digest[:16], version=4)}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record, gzipped."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    squeeze = zlib.compressobj(1, zlib.DEFLATED, 31)
    return squeeze.compress(b"".join([b"WARC/1.1\r\n", head.encode(), b"\r\n", block, b"\r\n\r\n"])) + squeeze.flush()


def capture_records(capture: str, fields: str, url: str, payload: bytes, digest: str, first: str | None) -> bytes:
    """The three records of a capture; first: the capture that has this payload already."""
    uri = " ".join(url.split()) or "about:blank"
    own, parts = record_id(capture, "response"), urlsplit("")
    try:
        parts = urlsplit(uri)
    except ValueError:
        pass  # an address that isn't one
    target = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri)]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    main = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if first is not None:
        main += [("WARC-Refers-To", record_id(first, "response")), ("WARC-Profile", REVISIT)]
    beside = lambda kind, media: [("WARC-Type", kind), ("WARC-Record-ID", record_id(capture, kind)), *common, ("WARC-Concurrent-To", own), ("Content-Type", media)]
    request = f"GET {target} HTTP/1.1\r\nHost: {parts.netloc}\r\n\r\n".encode()
    return b"".join([
        record(main, http if first is not None else http + payload),
        record(beside("request", "application/http;msgtype=request"), request),
        record(beside("metadata", "application/warc-fields"), fields.encode()),
    ])


class _Members:
    """The bytes of a gzip file of many members, read as they are asked for."""

    def __init__(self, stream):
        self.stream, self.inflate, self.ready, self.raw = stream, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        while True:
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(1 << 20)
                if not self.raw:
                    return False
            out, self.raw = self.inflate.decompress(self.raw), b""
            if self.inflate.eof:
                self.raw = self.inflate.unused_data
                self.inflate = zlib.decompressobj(31)
            if out:
                self.ready += out
                return True

    def until(self, mark: bytes) -> bytes | None:
        while (at := self.ready.find(mark)) < 0:
            if not self.more():
                if self.ready.strip():
                    raise ValueError("the archive ends inside a record")
                return None
        out, self.ready = self.ready[:at], self.ready[at + len(mark) :]
        return out

    def take(self, n: int) -> bytes:
        parts, have = [self.ready], len(self.ready)
        self.ready = b""
        while have < n:
            if not self.more():
                raise ValueError("the archive ends inside a block")
            parts.append(self.ready)
            have += len(self.ready)
            self.ready = b""
        whole = b"".join(parts)
        self.ready = whole[n:]
        return whole[:n]


def records(stream) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """(values of each header by lower-case name, block) of each record of a .warc.gz stream."""
    source = _Members(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        first, *lines = head.decode("utf-8", "replace").split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        headers: dict[str, list[str]] = {}
        for name, _, value in (line.partition(":") for line in lines):
            headers.setdefault(name.strip().lower(), []).append(value.strip())
        block = source.take(int(headers["content-length"][0]))
        source.take(4)
        yield headers, block


def write_archives(pages: DataFrame, path: str | None = None, id_col: str = "page_id") -> DataFrame:
    """Writes page_id (an integer), url, html into .warc.gz files; returns their manifest (path, n_records).

    Of equal payloads of LEAST_BYTES or more the smallest page_id (null is smallest) keeps the payload.
    Digests alone are grouped; pages with a large payload then meet their digest's first page in a join that
    Spark may split where a digest is hot, and small payloads join nothing.  A null html is an empty payload,
    a null url an empty address.  Rows that repeat a page_id are captures of their own, told apart by the
    row's number, and of equal payloads under the smallest page_id the first row keeps it; pages must give
    its rows in the same order whenever it is read, as stored tables do.  An empty table gives no files;
    other columns are not looked at."""
    import pyarrow as pa

    integral(pages, id_col)
    where = path or new_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = F.struct(key_of(id_col).alias("k"), F.monotonically_increasing_id().alias("row"))
    large = F.octet_length(payload) >= LEAST_BYTES
    digests = pages.select(own.alias("own"), F.sha2(payload, 256).alias("d"), large.alias("large")).where("large")
    shared = digests.groupBy("d").agg(F.min("own").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "first")
    rows = pages.select(own.alias("own"), F.col(id_col).cast("string").alias("id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"), large.alias("large"))
    alone = rows.where("not large").select("own", "id", "url", "payload", "digest", F.lit(None).cast("struct<k:bigint,row:bigint>").alias("first"))
    joined = alone.union(rows.where("large").join(shared, rows["digest"] == shared["d"], "left").select("own", "id", "url", "payload", "digest", "first"))
    flat = joined.select(F.concat_ws(" ", "own.k", "own.row").alias("own"), "id", "url", "payload", "digest", F.when(F.col("first") != F.col("own"), F.concat_ws(" ", "first.k", "first.row")).alias("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, out, count = TaskContext.get().partitionId(), 0, None, 0
        done = lambda: pa.RecordBatch.from_pydict({"path": [out.path], "n_records": pa.array([count], pa.int64())})
        for batch in batches:
            for own, page, url, body, digest, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    out, count = FileWriter(f"{where}/pages-{part:06d}-{seq:04d}.warc.gz"), 1
                    out.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(out.path, "warcinfo")), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                fields = f"page-id: {page}\r\n" if page is not None else "page-id:\r\n"
                out.write(capture_records(own, fields, url, body, digest, first))
                count += 3
                if out.size >= FILE_BYTES:
                    out.close()
                    yield done()
                    seq, out = seq + 1, None
        if out is not None:
            out.close()
            yield done()

    return materialize(map_arrow(flat, run, "path string, n_records long"), "archives")


def read_records(manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of the archives that manifest (path) lists, one row each, with the payload's own digest.
    concurrent_to lists every record that is named; refers_to and the other headers are the first of their name."""
    import pyarrow as pa

    schema = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("http_head", pa.string()), ("fields", pa.string()), ("n_bytes", pa.int64()), ("payload_sha256", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, size = [], 0
                with open_input(name) as stream:
                    for heads, block in records(stream):
                        head = lambda x: heads.get(x, [None])[0]  # noqa: B023, E731
                        kind, http, fields, body = head("warc-type"), None, None, None
                        if kind in ("response", "revisit", "request"):
                            http, _, body = block.partition(b"\r\n\r\n")
                            http = http.decode("utf-8", "replace")
                        else:
                            fields = block.decode("utf-8", "replace")
                        own = body if kind == "response" else None
                        rows.append((head("warc-record-id"), kind, heads.get("warc-concurrent-to", []), head("warc-refers-to"), head("warc-target-uri"), head("warc-date"), head("warc-payload-digest"), http, fields, None if own is None else len(own), None if own is None else hashlib.sha256(own).hexdigest(), own if with_payload else None))
                        size += len(block)
                        if size > 16 << 20 or len(rows) >= 5000:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    n = max(1, min(manifest.count(), 100_000))
    return map_arrow(manifest.select("path").repartitionByRange(n, "path"), run, "record_id string, type string, concurrent_to array<string>, refers_to string, uri string, date string, digest string, http_head string, fields string, n_bytes long, payload_sha256 string, payload binary")


MAIN, BESIDE = ("response", "revisit"), ("request", "metadata")
PARTS = {"response": ["record_id", "type", "refers_to", "uri", "date", "digest", "http_head", "n_bytes", "payload_sha256", "payload"], "request": ["record_id", "uri", "http_head"], "metadata": ["record_id", "fields"]}


def with_capture(found: DataFrame) -> DataFrame:
    """found with capture_id, equal for records that hang together by concurrent-to identifiers, whoever names whom.

    Where each request and metadata record names one response or revisit at most, and no other record names any,
    the capture is the one that is named.  Else the records' links are followed over any number of steps and in
    both directions, and the capture is the least id among them.  A name that no record has still ties those
    that use it."""
    beside, named = F.col("type").isin(*BESIDE), F.get("concurrent_to", 0)
    odd = found.where(F.size("concurrent_to") > F.when(beside, 1).otherwise(0)).limit(1).count()
    if not odd:
        main = found.where(F.col("type").isin(*MAIN)).select(F.col("record_id").alias("named"))
        odd = found.where(F.size("concurrent_to") > 0).select(named.alias("named")).join(main, "named", "left_anti").limit(1).count()
    if not odd:
        return found.withColumn("capture_id", F.coalesce(named, "record_id"))
    links = found.select(F.col("record_id").alias("h"), F.explode("concurrent_to").alias("root"))
    ids = components(links).select(F.col("h").alias("record_id"), F.col("root").alias("capture_id"))
    return found.join(ids, "record_id", "left").withColumn("capture_id", F.coalesce("capture_id", "record_id"))


def assemble(found: DataFrame) -> DataFrame:
    """One row per capture: capture_id, response (or revisit), request and metadata as structs, and others.

    Responses, requests and metadata are joined by their capture; a capture without one of the three has null
    there.  If it has several records of a kind the one with the least record id stands in the struct, and the
    others, with whatever kind of record it has besides, in others (record_id, type, uri, http_head, fields).
    Records that neither name nor are named by any, but for an archive's own warcinfo, are captures alone.
    Rows that repeat a record id are one record.  found is read more than once: write it first."""
    mine = found.where("type <> 'warcinfo' or size(concurrent_to) > 0").dropDuplicates(["record_id"])
    tied = with_capture(mine)
    more = F.struct("record_id", "type", "uri", "http_head", "fields")
    parts = {}
    for part, cols in PARTS.items():  # all have the capture as key, so that the joins move nothing again
        kinds = MAIN if part == "response" else (part,)
        listed = tied.where(F.col("type").isin(*kinds)).groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("record_id", F.struct(*cols).alias("own"), more.alias("more")))).alias("all"))
        parts[part] = listed.select("capture_id", F.col("all")[0]["own"].alias(part), F.expr("transform(slice(all, 2, size(all)), x -> x.more)").alias(f"more_{part}"))
    rest = tied.where(~F.col("type").isin(*MAIN, *BESIDE)).groupBy("capture_id").agg(F.array_sort(F.collect_list(more)).alias("more"))
    whole = parts["response"].join(parts["request"], "capture_id", "full").join(parts["metadata"], "capture_id", "full").join(rest, "capture_id", "full")
    none = F.array().cast("array<struct<record_id:string,type:string,uri:string,http_head:string,fields:string>>")
    return whole.select("capture_id", *PARTS, F.concat(*[F.coalesce(c, none) for c in ("more_response", "more_request", "more_metadata", "more")]).alias("others"))


def capture_report(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to per page, all from the archives."""
    made = assemble(materialize(read_records(write_archives(pages), with_payload=False), "records"))
    made = made.select(
        F.col("response.record_id").alias("id"), F.expr("try_cast(nullif(regexp_extract(metadata.fields, 'page-id: ?([^\\r\\n]*)', 1), '') as bigint)").alias("page_id"), F.col("response.type").alias("record_type"),
        F.col("response.refers_to").alias("named"), F.col("response.n_bytes").alias("n"), F.col("response.payload_sha256").alias("sha"))
    made = materialize(made, "captures")
    again = made.where("record_type = 'revisit'").select("page_id", "record_type", "named")
    firsts = made.where("record_type = 'response'").join(again.select(F.col("named").alias("id")).distinct(), "id", "left_semi").select("id", F.col("page_id").alias("refers_to"), "n", "sha")
    plain = made.where("record_type = 'response'").select("page_id", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", F.lit(None).cast("bigint").alias("refers_to"))
    return plain.union(again.join(firsts, F.col("named") == F.col("id"), "left").select("page_id", "n", "sha", "record_type", "refers_to"))
