"""WARC: archives of captures, and their assembly from request, response and metadata records.

Writing. Each capture becomes three records: a response (or a revisit, where an equal payload of at
least `LEAST` bytes was archived under a smaller id), and a request and a metadata record that name it
in WARC-Concurrent-To. Records are made by string functions and written by Spark's text writer with the
record end as line separator, so an archive file is a plain sequence of WARC records, is committed as
any Spark table, and survives lost executors. Equal payloads are found by their digests: the payloads
themselves are not shuffled to find them. A file takes about `ARCHIVE_BYTES`, as archives do: pages are written by classes of size, so
that no run of large ones makes a file of more than eight times that, unless it is one capture. A file is one gzip stream (a text writer makes no
member for each record).

Reading. Each archive is parsed by its Content-Length fields (payloads may hold anything, also record
ends), to a table of records. Transactions are assembled from that table by joins: the concurrent-to
ids, in either direction, tie requests and metadata to their capture; a revisit's refers-to id ties it
to the response that has its payload. Only responses that a revisit names take part in that join, once each, so it is a broadcast while they are few, and
responses are not dealt by it. One nested row per capture comes out.

Defined results: a null payload is empty; payloads below `LEAST` bytes are responses each; rows that
repeat an id with one payload are responses each, if the id is the least, under one record id; rows that repeat an id with unlike payloads are
captures of their own, as a record id is made of the id and the payload's digest; a null id is above all others;
an empty table gives an archive without records, and no rows. A capture without a request or metadata
record has null there; records whose capture is absent are dropped. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from engramlake.llm.common import observed

LEAST, ARCHIVE_BYTES = 100, 16 << 20
#: Payload bytes up to which pages are of a class that is written together; the last class has the rest.
SIZES = (32 << 10, 512 << 10, 8 << 20)
#: Digests of repeated payloads up to which the table of them (32 bytes and an id each) is broadcast; beyond, it is a shuffled join.
MOST_SHARED = 500_000
END, BREAK = "\r\n\r\n", "\r\n"
_PRIMARY = ("response", "revisit", "resource", "conversion")


def _uuid(kind: str, *of: Column) -> Column:
    """A record id from a hash of what identifies the record."""
    h = F.sha2(F.concat_ws("|", F.lit(kind), *[F.coalesce(c.cast("string"), F.lit("-")) for c in of]), 256)
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(kind: str, rid: Column, uri: Column, mime: str, block: Column, *more: Column) -> Column:
    """A record without its end; `more` are whole header lines."""
    clean = F.replace(F.replace(F.coalesce(uri, F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.concat(
        F.lit(f"WARC/1.1{BREAK}WARC-Type: {kind}{BREAK}WARC-Record-ID: "), rid,
        F.lit(f"{BREAK}WARC-Date: 2024-01-01T00:00:00Z{BREAK}WARC-Target-URI: "), clean, F.lit(BREAK), *more,
        F.lit(f"Content-Type: {mime}{BREAK}Content-Length: "), F.octet_length(block).cast("string"), F.lit(END), block,
    )


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))


def records(captures: DataFrame) -> DataFrame:
    """The texts of the records of captures: capture_id, url, payload, digest, first (the id to revisit, or null)."""
    rid = _uuid("capture", F.col("capture_id"), F.col("digest"))
    url, payload = F.col("url"), F.col("payload")
    head = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        F.octet_length(payload).cast("string"), F.lit(END),
    )
    digest = _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")))
    response = _record("response", rid, url, "application/http; msgtype=response", F.concat(head, payload), digest)
    revisit = _record(
        "revisit", rid, url, "application/http; msgtype=response", head, digest,
        _header("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        _header("WARC-Refers-To", _uuid("capture", F.col("first"), F.col("digest"))),
    )
    with_it = _header("WARC-Concurrent-To", rid)
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1)
    ask = F.concat(F.lit(f"GET / HTTP/1.1{BREAK}Host: "), F.regexp_replace(host, r"[\r\n]", ""), F.lit(END))
    request = _record("request", _uuid("request", F.col("capture_id"), F.col("digest")), url, "application/http; msgtype=request", ask, with_it)
    said = F.concat(F.lit("capture-id: "), F.coalesce(F.col("capture_id").cast("string"), F.lit("")), F.lit(BREAK))
    metadata = _record("metadata", _uuid("metadata", F.col("capture_id"), F.col("digest")), url, "application/warc-fields", said, with_it)
    answer = F.when(F.col("first").isNull(), response).otherwise(revisit)
    return captures.select(F.explode(F.array(request, answer, metadata)).alias("value"))


def with_firsts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """capture_id, url, payload, digest and first: the least id with an equal payload, where that is another's."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    base = pages.select(F.col(id_col).cast("long").alias("capture_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    base = base.withColumn("digest", F.sha2("payload", 256))
    large = base.filter(F.octet_length("payload") >= LEAST).groupBy(F.unhex("digest").alias("of"))
    shared = large.agg(F.min("capture_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    shared, (n,) = observed(shared, "warc-shared", F.count(F.lit(1)))
    met = base.join(F.broadcast(shared) if n <= MOST_SHARED else shared, F.unhex("digest") == F.col("of"), "left")
    first = F.when(~F.col("least").eqNullSafe(F.col("capture_id")), F.col("least"))
    return met.withColumn("first", first).drop("of", "least")


def write(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, **columns: str) -> None:
    """Write the captures of pages as gzip-compressed archives under a path."""
    captures = with_firsts(pages, **columns)
    size = F.octet_length("payload")
    kind = F.lit(0)
    for most in SIZES:
        kind = kind + F.when(size > most, 1).otherwise(0)
    payload = F.coalesce(F.col(columns.get("payload_col", "html")), F.lit(""))
    means = dict(pages.select(payload.alias("payload")).groupBy(kind.alias("kind")).agg(F.avg(size)).collect())  # a row for each class
    for n, (k, mean) in enumerate(sorted(means.items()) or [(0, 0)]):
        heaviest = SIZES[k] / 8 if k < len(SIZES) else archive_bytes
        per_file = 3 * max(1, int(archive_bytes / max(mean + 1500, heaviest)))
        out = records(captures.filter(kind == k)).write.mode("append" if n else "errorifexists").option("lineSep", END).option("compression", "gzip")
        out.option("maxRecordsPerFile", per_file).text(path)


def _headers(head: bytes) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for line in head.decode("utf-8", "replace").split(BREAK)[1:]:
        name, _, value = line.partition(":")
        out.setdefault(name.strip().lower(), []).append(value.strip())
    return out


def parse(data: bytes) -> Iterator[tuple[dict[str, list[str]], bytes]]:
    """Headers and block of every record of an archive, by the records' lengths."""
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        stop = data.find(END.encode(), at)
        if stop < 0:
            return
        headers = _headers(data[at:stop])
        length = headers.get("content-length", [""])[0]
        if not length.isdigit():
            at = stop
            continue
        begin = stop + len(END)
        yield headers, data[begin : begin + int(length)]
        at = begin + int(length)


_FIELDS = pa.schema([
    ("record_id", pa.string()), ("kind", pa.string()), ("url", pa.string()), ("concurrent_to", pa.list_(pa.string())),
    ("refers_to", pa.string()), ("said_digest", pa.string()), ("fields", pa.string()), ("bytes", pa.int64()),
    ("digest", pa.string()), ("payload", pa.binary()),
])
_RECORD = (
    "record_id string, kind string, url string, concurrent_to array<string>, refers_to string, said_digest string,"
    " fields string, bytes bigint, digest string, payload binary"
)


def _rows(data: bytes, payloads: bool) -> Iterator[dict]:
    for h, block in parse(data):
        one = lambda k: h.get(k, [None])[0]
        http = "application/http" in (one("content-type") or "")
        head, _, body = block.partition(END.encode()) if http else (block, b"", block)
        kind = one("warc-type")
        yield {
            "record_id": one("warc-record-id"), "kind": kind, "url": one("warc-target-uri"),
            "concurrent_to": h.get("warc-concurrent-to", []), "refers_to": one("warc-refers-to"),
            "said_digest": (one("warc-payload-digest") or "").partition(":")[2] or None,
            "fields": None if kind in _PRIMARY else head.decode("utf-8", "replace"), "bytes": len(body),
            "digest": hashlib.sha256(body).hexdigest(), "payload": body if payloads and kind in _PRIMARY else None,
        }


def _parse(payloads: bool):
    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip

        for batch in stream:
            for data in batch.column("content"):
                raw = data.as_buffer()
                raw = gzip.decompress(raw) if raw[:2].to_pybytes() == b"\x1f\x8b" else raw.to_pybytes()
                rows, size = [], 0
                for row in _rows(raw, payloads):
                    rows.append(row)
                    size += len(row["payload"] or b"")
                    if len(rows) >= 2000 or size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_FIELDS)

    return run


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{gz,warc,txt}").load(path)
    return files.select("content").mapInArrow(_parse(payloads), _RECORD)


def assemble(found: DataFrame) -> DataFrame:
    """One nested row per capture: record_id, url, kind, bytes and digest of the full payload, refers_to, request, metadata."""
    main = F.col("kind").isin(*_PRIMARY)
    own = found.filter(main)
    to = F.explode("concurrent_to").alias("to")
    near = found.filter(~main).select("record_id", "kind", "fields")
    # both directions: the record names its capture, or the capture names the record
    names = found.filter(~main).select(F.col("record_id"), to)
    told = own.select(F.col("record_id").alias("to"), F.explode("concurrent_to").alias("record_id")).select("record_id", "to")
    ties = names.unionByName(told).distinct()
    part = lambda k: F.max(F.when(F.col("kind") == k, F.struct("record_id", "fields")))
    sides = near.join(ties, "record_id").groupBy(F.col("to").alias("record_id"))
    sides = sides.agg(part("request").alias("request"), part("metadata").alias("metadata"))
    of = F.regexp_extract("metadata.fields", r"(?:^|\n)capture-id: (-?\d+)", 1)
    whole = own.join(sides, "record_id", "left").drop("fields", "concurrent_to")
    whole = whole.withColumn("capture_id", F.when(of != "", of.cast("long")))
    named = own.filter("kind = 'revisit'").select(F.col("refers_to").alias("to")).distinct()
    firsts = own.filter("kind <> 'revisit'").join(named, F.col("record_id") == F.col("to"), "left_semi")
    firsts = firsts.select("record_id", "bytes").dropDuplicates(["record_id"]).join(sides, "record_id", "left")
    firsts = firsts.select(F.col("record_id").alias("refers_to"), F.col("bytes").alias("first_bytes"), F.when(of != "", of.cast("long")).alias("first_id"))
    firsts, (n,) = observed(firsts, "warc-firsts", F.count(F.lit(1)))
    again = whole.filter("kind = 'revisit'").join(F.broadcast(firsts) if n <= MOST_SHARED else firsts, "refers_to", "left")
    said = lambda size, digest, to: ("capture_id", "record_id", "url", F.col("kind").alias("record_type"), F.col(size).alias("payload_bytes"), digest.alias("payload_digest"), to.alias("refers_to"), "payload", "request", "metadata")
    answers = whole.filter("kind <> 'revisit'").select(*said("bytes", F.col("digest"), F.lit(None).cast("long")))
    return answers.unionByName(again.select(*said("first_bytes", F.coalesce("said_digest", "digest"), F.col("first_id"))))
