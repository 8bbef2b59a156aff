"""WARC archives: writing, and normalising whole-file gzip streams.

Archives are first written as one gzip stream each. The normaliser inflates
such a stream once, from front to end, cuts it into records, rewrites every
record as a gzip member of its own, and writes an index of the members' offsets
beside the archive, so that a reader can open any record alone.

Tasks write files to the shared folder under names no other attempt uses, and
return them; only names in a stored manifest are read later.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from impactspark.llm.common import ship, stored, whole_text
from impactspark.llm.files import attempt_name, make_folder, opened, written
from impactspark.sources.folders import fresh_dir

MIN_REVISIT = 100  # bytes from which equal payloads are written once
FILE_BYTES = 256_000_000  # uncompressed bytes after which the next archive begins
READ = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 16 + zlib.MAX_WBITS


def _clean(value: str) -> str:
    """A header value on one line: control characters percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, record_id: str) -> bytes:
    """One record. A revisit has the HTTP head of the full payload but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",  # pages carry no time; equal runs write equal bytes
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {_clean(url)}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def header(head: bytes) -> dict[str, str]:
    rows = (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in rows}


def inflated(source) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, a portion at a time."""
    engine, waiting = zlib.decompressobj(GZIP), b""
    while True:
        data = waiting or source.read(READ)
        waiting = b""
        if not data:
            if not engine.eof:
                raise EOFError("the gzip stream ends early")
            return
        if engine.eof:
            engine = zlib.decompressobj(GZIP)
        out = engine.decompress(data, READ)
        waiting = engine.unused_data if engine.eof else engine.unconsumed_tail
        if out:
            yield out


def records(portions: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Cut a stream into records: header fields and the record's whole bytes.
    One record is in memory at a time."""
    held = bytearray()

    def fill(enough) -> bool:
        while not enough():
            more = next(portions, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while fill(lambda: b"\r\n\r\n" in held):
        end = held.index(b"\r\n\r\n") + 4
        fields = header(bytes(held[: end - 4]))
        total = end + int(fields["content-length"]) + 4
        if not fill(lambda: len(held) >= total):  # noqa: B023
            break
        yield fields, bytes(held[:total])
        del held[:total]
    if held.strip():
        raise EOFError("the last record is cut off")


def _packed(data: bytes, level: int = 6) -> bytes:
    engine = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return engine.compress(data) + engine.flush()


WRITTEN = "path string, n_records long"
NORMAL = "path string, index string, n_records long, n_bytes long"


def decided(pages: DataFrame) -> DataFrame:
    """Per row of `pages` (page_id, url, html): the payload, its size and digest,
    record_type and refers_to.

    A NULL page is an empty payload. Of equal payloads of at least MIN_REVISIT
    bytes, the row with the smallest page_id is the response; rows that repeat
    that page_id are responses as well, and so are all if none has an id.
    """
    rows = pages.select("page_id", "url", whole_text("html").alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha2(F.encode("payload", "UTF-8"), 256))
    large = rows.filter(F.col("payload_bytes") >= MIN_REVISIT)
    # only digests met more than once go on; per digest one row
    first = large.groupBy(F.col("payload_digest").alias("__digest")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = rows.join(first, (F.col("payload_bytes") >= MIN_REVISIT) & (F.col("payload_digest") == F.col("__digest")), "left").drop("__digest")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first"))).drop("first")


def write(rows: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write `decided` rows to archives of one gzip stream each; the stored
    manifest has one row per archive."""
    ship(rows.sparkSession)
    make_folder(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, seq, at = TaskContext.get().partitionId(), 0, 0
        batches = (r for batch in batches for r in batch.itertuples(index=False))
        row = next(batches, None)
        while row is not None:
            path, n, size = f"{folder}/{attempt_name(f'pages-{part:06d}-{seq:04d}', '.warc.gz')}", 0, 0
            engine = zlib.compressobj(6, zlib.DEFLATED, GZIP)
            with written(path) as out:
                while row is not None and size < file_bytes:
                    page_id = None if row.page_id is None else int(row.page_id)
                    refers = None if row.refers_to is None else int(row.refers_to)
                    name = hashlib.md5(f"{part}/{at}/{page_id}/{row.payload_digest}".encode()).hexdigest()
                    name = "-".join((name[:8], name[8:12], name[12:16], name[16:20], name[20:]))
                    data = record(row.record_type, page_id, row.url, (row.payload or "").encode(), int(row.payload_bytes), row.payload_digest, refers, name)
                    out.write(engine.compress(data))
                    n, size, at = n + 1, size + len(data), at + 1
                    row = next(batches, None)
                out.write(engine.flush())
            yield pd.DataFrame({"path": [path], "n_records": [n]})
            seq += 1

    # a revisit has no use for the payload; ids as text, where NULL stays NULL
    thin = rows.select(
        F.col("page_id").cast("string"), "url", F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"),
        "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("string"),
    )
    return stored(thin.mapInPandas(run, WRITTEN), "warc-written")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives (path) of any gzip layout so that each record is a member
    of its own, with an index file beside each: one JSON line per record with
    offset, length, type, page id and digest. Returns the stored manifest."""
    ship(archives.sparkSession)
    make_folder(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                target = f"{folder}/{attempt_name('members', '.warc.gz')}"
                n = at = 0
                with opened(path) as source, written(target) as out, written(f"{target}.idx") as index:
                    for fields, data in records(inflated(source)):
                        member = _packed(data)
                        out.write(member)
                        line = {"offset": at, "length": len(member), "type": fields["warc-type"]}
                        line |= {"page": fields.get("warc-page-id"), "digest": fields.get("warc-payload-digest"), "url": fields.get("warc-target-uri")}
                        index.write(json.dumps(line).encode() + b"\n")
                        n, at = n + 1, at + len(member)
                yield pd.DataFrame({"path": [target], "index": [f"{target}.idx"], "n_records": [n], "n_bytes": [at]})

    return stored(archives.select("path").repartition(F.col("path")).mapInPandas(run, NORMAL), "warc-normal")


def member(path: str, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its index entry: header fields and block."""
    with opened(path) as source:
        return _parsed(source, offset, length)


def _parsed(source, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    source.seek(offset)
    data = zlib.decompress(source.read(length), GZIP)
    end = data.index(b"\r\n\r\n") + 4
    fields = header(data[: end - 4])
    return fields, data[end : end + int(fields["content-length"])]


PAGES = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read(manifest: DataFrame) -> DataFrame:
    """Read normalised archives back through their indexes, a row per record. A
    revisit's payload is NULL, its size and digest are those of the full one; a
    response whose bytes do not match its digest is an error."""
    ship(manifest.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = lambda x: None if x is None else int(x)
        for batch in batches:
            for path, index in zip(batch["path"], batch["index"], strict=True):
                rows, size = [], 0
                with opened(path) as source, opened(index) as entries:
                    for line in _text_lines(entries):
                        entry = json.loads(line)
                        fields, block = _parsed(source, entry["offset"], entry["length"])
                        end = block.index(b"\r\n\r\n") + 4
                        http = header(block[: end - 4])
                        payload = block[end:] if fields["warc-type"] == "response" else None
                        digest = fields["warc-payload-digest"].removeprefix("sha256:")
                        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{path} at {entry['offset']}: the payload does not match its digest")
                        rows.append(
                            (whole(fields.get("warc-page-id")), fields.get("warc-target-uri"), int(http["content-length"]), digest, fields["warc-type"],
                             whole(fields.get("warc-refers-to-page-id")), payload)
                        )
                        size += len(block)
                        if size > 8 * READ:
                            yield _frame(rows)
                            rows, size = [], 0
                if rows:
                    yield _frame(rows)

    return manifest.select("path", "index").repartition(F.col("path")).mapInPandas(run, PAGES)


def _text_lines(source) -> Iterator[bytes]:
    held = b""
    while data := source.read(READ):
        *done, held = (held + data).split(b"\n")
        yield from done


def _frame(rows: list[tuple]) -> pd.DataFrame:
    names = [c.split()[0] for c in PAGES.split(", ")]
    out = pd.DataFrame(rows, columns=names)
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, normalise the archives and read them back."""
    spark = pages.sparkSession
    first = write(decided(pages), fresh_dir(spark, "warc-streams"))
    return read(normalise(first, fresh_dir(spark, "warc-members")))

