"""Operator 2: WARC archives with per-file Zstandard dictionaries.

``write_warc`` writes ``pages`` as ``.warc.zst`` files: a leading skippable
frame (magic 0x184D2A5D) holds a dictionary trained on the file's own records,
and every record is a frame of its own compressed with it, so records can be
read singly. Of records with equal payloads of at least ``min_bytes`` the one
with the largest page id is the ``response``; the others are ``revisit``
records that name it.

Plan: one light aggregate finds the digests that occur more than once and
their largest page id (map-side combined, so a hot payload is one row per
task); the pages are joined to that table on the digest, with adaptive
skew-join splitting for a hot payload, and every task of the join writes one
file. The payload is written once per distinct content.

The dictionary is trained on at most ``sample_bytes`` of records at the head
of the file's input (in digest order, and so a uniform sample, where the join
shuffles; in the table's order where it needs no shuffle); it only affects
size, never content. A file with too few records
to train on has no dictionary frame.

Edge cases: NULL html is an empty payload; NULL url gives no target URI, and
control characters in a url are percent-encoded; a NULL page id never becomes
the response another record names, and is a response itself only if no page
with its payload has an id; repeated rows with the largest id are all
responses; an empty table gives no file and an empty result; other columns
are never read. A task writes under a name of its own and renames at the end.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltaic.llm.common import open_fs, shuffle_partitions, stored

# FIXED VALUES of the formats
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
                 "url string, file string")


def record_id(page_id, digest: str) -> str:
    """Record id that any task can derive: a version 5 UUID of page id and payload digest."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _header_text(value: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def warc_record(page_id, url, payload: bytes, size: int, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record: HTTP response block, or a revisit block of the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}",
            f"WARC-Date: {date}", "Content-Type: application/http;msgtype=response",
            f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header_text(url)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}",
                 f"X-Refers-To-Page-ID: {refers_to}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + f"\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def _train(records: list[bytes], dictionary_bytes: int):
    import zstandard
    try:
        return zstandard.train_dictionary(dictionary_bytes, records)
    except zstandard.ZstdError:  # too few or too small records
        return None


def _write_files(out_dir: str, date: str, level: int, dictionary_bytes: int, sample_bytes: int):
    def run(batches):
        import pyarrow as pa
        import zstandard
        from pyspark import TaskContext

        fs, root = open_fs(out_dir)
        fs.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        own, name = f"{root}/_writing-{part:05d}-{uuid.uuid4().hex}", f"part-{part:05d}.warc.zst"
        sink = compressor = None
        held: list[bytes] = []
        held_bytes = records = 0

        def start():
            nonlocal sink, compressor
            sink = fs.open_output_stream(own)
            dictionary = _train(held, dictionary_bytes)
            if dictionary:
                raw = dictionary.as_bytes()
                sink.write(SKIPPABLE_MAGIC.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw)
            compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary)
            for r in held:
                sink.write(compressor.compress(r))
            held.clear()

        try:
            for batch in batches:
                for piece in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                    for row in piece.to_pylist():
                        record = warc_record(row["page_id"], row["url"], (row["body"] or "").encode(), row["size"],
                                             base64.b32encode(row["digest"]).decode(), row["refers_to"], date)
                        records += 1
                        if sink is None:
                            held.append(record)
                            held_bytes += len(record)
                            if held_bytes >= sample_bytes:
                                start()
                        else:
                            sink.write(compressor.compress(record))
            if records and sink is None:
                start()
        finally:
            if sink is not None:
                sink.close()
        if records:
            fs.move(own, f"{root}/{name}")
            yield pa.record_batch([[name], [records]], names=["file", "records"])
    return run


def write_warc(pages: DataFrame, out_dir: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 3,
               dictionary_bytes: int = 64 << 10, sample_bytes: int = 6 << 20) -> DataFrame:
    """Write one record per page; returns the files written (file, records)."""
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest = F.unhex(F.sha1(F.col("html").cast("binary")))
    large = F.octet_length("html") >= min_bytes
    # a payload that occurs once needs no row here: it is a response of its own
    kept = (rows.where(large).groupBy(digest.alias("digest")).agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
            .where("n > 1").select("digest", "kept"))
    kept = stored(kept, "warc-kept")
    joined = rows.withColumn("digest", digest).join(kept, "digest", "left")
    other = F.when(large & ~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    records = joined.select("page_id", "url", other.alias("refers_to"), F.octet_length("html").cast("long").alias("size"),
                            "digest", F.when(other.isNull(), F.col("html")).alias("body"))
    files = records.mapInArrow(_write_files(out_dir, date, level, dictionary_bytes, sample_bytes),
                               "file string, records long")
    return stored(files, "warc-files")


def read_frames(data):
    """Records of one ``.warc.zst`` buffer, dictionary frame first if there is one."""
    import zstandard
    view, at, dictionary = memoryview(data), 0, None
    if len(view) >= 8 and int.from_bytes(view[:4], "little") == SKIPPABLE_MAGIC:
        size = int.from_bytes(view[4:8], "little")
        dictionary, at = zstandard.ZstdCompressionDict(bytes(view[8:8 + size])), 8 + size
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(view):
        frame = decompressor.decompressobj()
        parts, window = [], 1 << 16
        while not frame.eof:  # frames follow one another: feed until this one ends
            chunk = view[at:at + window]
            parts.append(frame.decompress(chunk))
            at += len(chunk) - len(frame.unused_data)
            if not len(chunk):
                raise ValueError("archive ends inside a record")
        yield b"".join(parts)


def parse_record(record: bytes) -> dict:
    """Headers and payload of one record; the payload of a revisit is empty."""
    head, _, block = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = block[:int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"fields": fields, "payload": block.partition(b"\r\n\r\n")[2]}


def _read_files(out_dir: str):
    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                            ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()),
                            ("file", pa.string())])
        fs, root = open_fs(out_dir)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out = []
                with fs.open_input_file(f"{root}/{name}") as f:
                    for raw in read_frames(f.read_buffer()):
                        rec = parse_record(raw)
                        h = rec["fields"]
                        size, digest = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
                        if h["WARC-Type"] == "response":  # both measured on the payload that was read
                            size = len(rec["payload"])
                            digest = base64.b32encode(hashlib.sha1(rec["payload"]).digest()).decode()
                        page, other = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                        out.append((None if page is None else int(page), size, digest, h["WARC-Type"],
                                    None if other is None else int(other), h.get("WARC-Target-URI"), name))
                        if len(out) >= 5000:
                            yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
                            out = []
                if out:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
    return run


def read_warc(spark: SparkSession, out_dir: str, files: DataFrame) -> DataFrame:
    """One row per record of the named files."""
    spread = files.select("file").repartition(shuffle_partitions(spark))
    return spread.mapInArrow(_read_files(out_dir), RECORD_SCHEMA)
