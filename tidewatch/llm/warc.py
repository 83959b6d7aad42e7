"""Web archives: writing captures as WARC records, reading archives, and assembling the records of each capture.

A capture is three records: the response (or, where another one has the same payload, a revisit that refers to it), and its
request and metadata, which name it as concurrent. Archives are written by Spark's text writer, whose separator between rows
is what WARC puts behind each record (so a file is one gzip member). Compressed archives are read by its text reader as a
stream, cut at the same separator, of which no more than a record is held; others are read whole, file by file.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END = "\r\n\r\n"
#: Payloads of at least so many bytes are stored once; records of a file at most.
LEAST_REVISIT, RECORDS_A_FILE = 100, 6_000
#: Records, and bytes of theirs, that are handed on together.
ROWS, BYTES = 2000, 4 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = pa.schema([("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("date", pa.string()), ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("head", pa.string()), ("payload", pa.binary())])
DDL = "record_id string, type string, uri string, concurrent_to string, refers_to string, date string, digest string, payload_bytes long, payload_digest string, head string, payload binary"


def urn(*names: Column | str) -> Column:
    """A record id made of names, the same on each run."""
    h = F.md5(F.concat_ws("\x1f", *[F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("\x1e")) for x in names]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), h.substr(13, 4), h.substr(17, 4), h.substr(21, 12)), F.lit(">"))


def record(kind: Column | str, record_id: Column, uri: Column, content: str, block: Column, more: dict[str, Column]) -> Column:
    """A record's text up to the end of its block. Fields whose value is null are left out."""
    fields = {"WARC-Type": F.lit(kind) if isinstance(kind, str) else kind, "WARC-Record-ID": record_id, "WARC-Date": F.lit(DATE), "WARC-Target-URI": uri, **more, "Content-Type": F.lit(content), "Content-Length": F.octet_length(block).cast("string")}
    lines = [F.when(v.isNotNull(), F.concat(F.lit(f"{k}: "), v, F.lit("\r\n"))).otherwise(F.lit("")) for k, v in fields.items()]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"), block)


def write(pages: DataFrame, path: str) -> None:
    """Archives of pages (page_id, url, html) at a path that all executors reach.

    Of rows whose payloads (html as UTF-8; null: empty) are equal and of LEAST_REVISIT bytes or more, the one with the smallest
    page_id is the response and the others revisit it; rows that repeat that page_id are responses too. Null page_ids come
    last. Line breaks in a url are written percent-encoded, and a null url leaves the target out. No rows make archives without
    records; a page of any length is a record like any other.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = common.own_columns(pages, ["page_id", "url", "html"]).select("page_id", "url", body.alias("body")).withColumns({"size": F.octet_length("body"), "sha": F.sha2(F.col("body").cast("binary"), 256)})
    large = rows.filter(F.col("size") >= LEAST_REVISIT)
    # only what is there twice needs to be told to its copies
    first = large.groupBy("sha").agg(F.count("*").alias("n"), F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")).alias("first")).filter("n > 1")
    rows = rows.join(first.select("sha", "first"), "sha", "left")
    revisit = (F.col("size") >= LEAST_REVISIT) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    uri = F.regexp_replace(F.regexp_replace(F.col("url"), "\r", "%0D"), "\n", "%0A")
    main = urn("main", F.col("page_id"), F.col("url"), F.col("sha"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(END))
    of_page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    target = urn("main", F.col("first.page_id"), F.col("first.url"), F.col("sha"))
    records = F.array(
        record(F.when(revisit, "revisit").otherwise("response"), main, uri, "application/http; msgtype=response", F.when(revisit, http).otherwise(F.concat(http, F.col("body"))), {"WARC-Payload-Digest": F.concat(F.lit("sha256:"), F.col("sha")), "WARC-Profile": F.when(revisit, PROFILE), "WARC-Refers-To": F.when(revisit, target)}),
        record("request", urn("request", F.col("page_id"), F.col("url"), F.col("sha")), uri, "application/http; msgtype=request", F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1" + END)), {"WARC-Concurrent-To": main}),
        record("metadata", urn("metadata", F.col("page_id"), F.col("url"), F.col("sha")), uri, "application/warc-fields", F.concat(F.lit("pageId: "), of_page, F.lit("\r\n")), {"WARC-Concurrent-To": main}),
    )
    rows.select(F.explode(records).alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


def parse(chunks: Iterable[bytes], payloads: bool) -> Iterator[tuple]:
    """The records of an archive that comes in chunks, in RECORD's columns. A broken record raises ValueError; what follows a
    last record but separators is none."""
    end, held, size, source = END.encode(), bytearray(), 0, iter(chunks)

    def more(least: int) -> bool:
        while len(held) < least:
            chunk = next(source, None)
            if chunk is None:
                return False
            held.extend(chunk)
        return True

    while True:
        at = held.find(end)
        while at < 0 and more(len(held) + 1):
            at = held.find(end)
        if not held.strip():
            if not more(len(held) + 1):
                return
            continue
        if not held.startswith(b"WARC/") or at < 0:
            raise ValueError(f"no WARC record where {bytes(held[:20])!r} is")
        field = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in held[:at].decode().split("\r\n")[1:])}
        size = int(field["content-length"])
        if not more(at + 4 + size):
            raise ValueError(f"record {field.get('warc-record-id')} is cut")
        block = bytes(held[at + 4 : at + 4 + size])
        if more(at + 8 + size) and held[at + 4 + size : at + 8 + size] != end:
            raise ValueError(f"record {field.get('warc-record-id')} is cut")
        del held[: at + 8 + size]
        head, _, payload = block.partition(end) if field.get("content-type", "").startswith("application/http") else (block, b"", b"")
        full = field["warc-type"] == "response"
        yield (field.get("warc-record-id"), field["warc-type"], field.get("warc-target-uri"), field.get("warc-concurrent-to"), field.get("warc-refers-to"), field.get("warc-date"), field.get("warc-payload-digest"), len(payload) if full else None, hashlib.sha256(payload).hexdigest() if full else None, head.decode("utf-8", "replace"), payload if payloads and full else None)


def record_batches(records: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for x in records:
        rows.append(x)
        size += len(x[-1] or b"")
        if len(rows) == ROWS or size > BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORD, strict=True)], schema=RECORD)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORD, strict=True)], schema=RECORD)


def by_file(rows: Iterator[tuple[str, bytes]]) -> Iterator[Iterator[bytes]]:
    """Of rows (file, chunk) each file's chunks, with the separators that they were cut at."""
    held = next(rows, None)

    def of(name: str) -> Iterator[bytes]:
        nonlocal held
        while held is not None and held[0] == name:
            yield held[1] + END.encode()
            held = next(rows, None)

    while held is not None:
        chunks = of(held[0])
        yield chunks
        for _ in chunks:
            pass


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """The records of all archives at a path, compressed (*.gz) or not; payloads only on request. No archives, no records."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((f, c.as_py() or b"") for batch in batches for f, c in zip(batch["file"].to_pylist(), batch["chunk"], strict=True))
        yield from record_batches(x for chunks in by_file(rows) for x in parse(chunks, payloads))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch["content"]:
                yield from record_batches(parse([data.as_py()], payloads))

    common.bound_batches(spark)
    packed = spark.read.option("lineSep", END).option("pathGlobFilter", "*.gz").text(path).select(F.input_file_name().alias("file"), F.col("value").cast("binary").alias("chunk"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc").load(path).select("content")
    return packed.mapInArrow(stream, DDL).union(plain.mapInArrow(whole, DDL))


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, copies, main, request, metadata (structs of a record's fields).

    Requests and metadata belong to the record that they name as concurrent to. copies is how often the main record is there;
    a capture whose main record is missing has copies 0 and a null main.
    """
    fields = [c for c in records.columns if c != "capture_id"]
    kind = F.col("type")
    is_main = kind.isin("response", "revisit", "resource")
    of = lambda cond: F.max(F.when(cond, F.struct(*fields)))
    return records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(F.count(F.when(is_main, 1)).alias("copies"), of(is_main).alias("main"), of(kind == "request").alias("request"), of(kind == "metadata").alias("metadata"))


def captures(assembled: DataFrame) -> DataFrame:
    """Per capture (as often as it was written): page_id, payload_bytes, payload_digest, record_type, refers_to, uri.

    A revisit's payload is that of the response it refers to, whose page_id is refers_to.
    """
    page = F.regexp_extract("metadata.head", r"^pageId: (-?\d+)\r\n", 1)
    flat = assembled.filter("copies > 0").select("capture_id", "copies", F.when(page != "", page.cast("long")).alias("page_id"), F.col("main.type").alias("record_type"), F.col("main.refers_to").alias("to"), F.col("main.uri").alias("uri"), F.col("main.payload_bytes").alias("payload_bytes"), F.col("main.payload_digest").alias("payload_digest"))
    flat, _ = common.written(flat, "captures")  # read three times, without the archives
    revisits = flat.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    told = flat.filter("record_type != 'revisit'").select(F.col("capture_id").alias("to"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    wanted = told.join(revisits.select("to").distinct(), "to", "left_semi")
    columns = ["copies", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "uri"]
    both = flat.filter("record_type != 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(revisits.join(wanted, "to", "left").select(*columns))
    return both.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies")
