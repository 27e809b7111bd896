"""Dictionary-compressed WARC archives (operator 3).

Each writing task builds a Zstandard dictionary from its own records, stores it in a leading skippable frame and
compresses every record as a frame of its own (``.warc.zst``). Archives are files in a shared folder, written and read
through ``pyarrow.fs``, so any store it knows will do. A manifest row names each finished file; files of lost
or repeated attempts are in no manifest and are never read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.common import fresh_path, written

#: Frame types of the .warc.zst format.
DICTIONARY_FRAME = 0x184D2A5D
#: Records of at least so many payload bytes are stored once; later copies refer to the first.
REVISIT_BYTES = 100
#: Dictionary: its size, and the record bytes of one archive that it is built from.
DICTIONARY_BYTES = 64 << 10
SAMPLE_BYTES = 4 << 20
#: A new archive begins beyond so many payload bytes.
ARCHIVE_BYTES = 256 << 20
_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string, payload binary"
_MANIFEST = "archive string, records long, bytes long"
_WANTED = ["page_id", "url", "payload", "size", "digest", "first_id", "first_url", "revisit"]
#: Equal rows that one task writes, where a row is repeated more often.
REPEATS = 1000


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1) if uri.startswith("file:") else f"file://{uri}")


def _line(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, first_url: str | None, revisit: bool,
           size: int | None = None) -> bytes:
    """One WARC/1.1 record. A revisit carries the HTTP header alone, whose Content-Length is that of the full payload (``size``, where the
    payload isn't at hand)."""
    name = lambda i: "null" if i is None else str(i)
    uri = lambda u, i: _line(u) if u else f"urn:page:{name(i)}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{name(page_id)}>",
        f"WARC-Target-URI: {uri(url, page_id)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{name(refers_to)}>", f"WARC-Refers-To-Target-URI: {uri(first_url, refers_to)}",
        ]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> bytes:
    """Dictionary of the sampled records; where they are too few to train one, their own bytes serve as a raw one."""
    samples = [s for s in samples if s]
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:DICTIONARY_BYTES]


class ArchiveWriter:
    """Writes one archive: skippable dictionary frame, then one frame for each record."""

    def __init__(self, sink, dictionary: bytes):
        self.sink, self.records, self.bytes = sink, 0, 0
        kept = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.codec = zstandard.ZstdCompressor(level=3, dict_data=kept, write_content_size=True)
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.bytes += len(data)

    def add(self, data: bytes) -> None:
        self._put(self.codec.compress(data))
        self.records += 1


def read_records(source) -> Iterator[bytes]:
    """Records of one archive, in order; memory holds one read block and one record."""
    magic, size = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    dictionary = source.read(size)
    kept = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    data = source.read(1 << 20)
    frame, out, within = kept.decompressobj(), io.BytesIO(), False
    while data:
        out.write(frame.decompress(data))
        within = not frame.eof
        if within:
            data = source.read(1 << 20)
        else:
            data = frame.unused_data or source.read(1 << 20)
            yield out.getvalue()
            frame, out = kept.decompressobj(), io.BytesIO()
    if within:
        raise ValueError("archive ends within a record")


def parse_record(data: bytes) -> dict:
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields["WARC-Type"]
    number = lambda v: None if v is None or v == "<urn:page:null>" else int(v[len("<urn:page:"):-1])
    full = int(re.search(rb"Content-Length: (\d+)", http)[1])
    if kind == "response" and (len(payload) != full or hashlib.sha256(payload).hexdigest() != fields["WARC-Payload-Digest"][7:]):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
    return {
        "page_id": number(fields["WARC-Record-ID"]), "payload_bytes": full, "payload_digest": fields["WARC-Payload-Digest"][7:],
        "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To")), "target_uri": fields["WARC-Target-URI"],
        "payload": payload if kind == "response" else None,
    }


def _write_archives(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        rows = _records(batches)
        held, size, done = [], 0, False
        while not done:
            for data in rows:  # the dictionary comes first in the file, so its sample is read ahead
                held.append(data)
                size += len(data)
                if size >= SAMPLE_BYTES:
                    break
            else:
                done = True
            if not held:
                break
            path = f"{base}/{uuid.uuid4().hex}.warc.zst"
            with fs.open_output_stream(path, compression=None) as sink:
                out = ArchiveWriter(sink, build_dictionary(held))
                for data in held:
                    out.add(data)
                held = []
                while size < archive_bytes and not done:
                    data = next(rows, None)
                    if data is None:
                        done = True
                    else:
                        out.add(data)
                        size += len(data)
            size = 0
            yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{path.rsplit('/', 1)[1]}"], "records": [out.records], "bytes": [out.bytes]})

    return run


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
    for batch in batches:
        for r in batch.to_pylist():
            yield record(r["page_id"], r["url"], (r["payload"] or "").encode(), r["digest"], r["first_id"], r["first_url"], r["revisit"], r["size"])


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows of the first id of their payload that occur several times: one stays as the response, the others become revisits. Equal
    rows are counted before the shuffle, and the revisits of a row are dealt in parts."""
    equal = rows.groupBy("page_id", "digest", "url", "size", "first_id", "first_url").agg(F.first("payload").alias("payload"), F.count("*").alias("n"))
    one = F.col("url").eqNullSafe(F.col("first_url"))
    response = equal.where(one).withColumn("revisit", F.lit(False)).select(*_WANTED)
    rest = equal.withColumn("n", F.col("n") - one.cast("long")).where("n > 0").drop("payload")
    parts = rest.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / REPEATS))))
    dealt = parts.repartition("page_id", "digest", "url", "part")
    each = F.array_repeat(F.lit(1), F.least(F.lit(REPEATS).cast("long"), F.col("n") - F.col("part") * REPEATS).cast("int"))
    others = dealt.withColumn("one", F.explode(each)).withColumn("revisit", F.lit(True)).withColumn("payload", F.lit(None).cast("string"))
    return response.union(others.select(*_WANTED))


def write_archives(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html",
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write one record for each row and return the manifest (archive, records, bytes).

    Of equal payloads of at least ``REVISIT_BYTES`` bytes the one with the smallest page_id is the response, the others
    revisit it. A null html is an empty payload. Of repeated rows of that id one, with the smallest url, is the response and the others
    revisit their own id, wherever they stand. Null page ids come after all others. Digests alone decide who is first: only (id, digest)
    rows meet there, and a digest that many pages share is counted before the shuffle and split in the join. Payloads are dealt at most
    once, by page.
    """
    folder = fresh_path(pages.sparkSession, "warc")
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))
    keys = rows.where(F.col("size") >= REVISIT_BYTES).select("page_id", "digest", "url")
    first = keys.groupBy("digest").agg(
        F.count("*").alias("n"),
        F.min(F.struct(F.col("page_id").isNull().alias("last"), "page_id", "url")).alias("first"))
    counted = keys.groupBy("page_id", "digest").agg(F.count("*").alias("times"))
    copies = written(
        counted.join(first.where("n > 1").select("digest", "first"), "digest")
        .select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "times", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")),
        "copies")
    same = rows["page_id"].eqNullSafe(copies["p"]) & (rows["digest"] == copies["d"])
    decided = rows.join(copies, same, "left").withColumn(
        "first_id", F.when(F.col("d").isNull(), F.col("page_id")).otherwise(F.col("first_id")))
    own = F.col("page_id").eqNullSafe(F.col("first_id"))
    often = F.col("d").isNotNull() & own & (F.col("times") > 1)
    out = decided.where(~often).withColumn("revisit", ~own).select(*_WANTED)
    if not copies.where(F.col("p").eqNullSafe(F.col("first_id")) & (F.col("times") > 1)).isEmpty():
        out = out.union(_repeated(decided.where(often)))
    ordered = out.sortWithinPartitions("page_id", "digest", "revisit")
    return written(ordered.mapInArrow(_write_archives(folder, archive_bytes), _MANIFEST), "manifest")


def read_archives(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every record of the archives named in ``manifest``; payload is null for revisits. One task reads a file from
    start to end; there are as many tasks as files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive").to_pylist():
                fs, path = filesystem(uri)
                with fs.open_input_stream(path, compression=None) as source:
                    rows, size = [], 0
                    for data in read_records(source):
                        rows.append(parse_record(data))
                        size += len(data)
                        if size >= SAMPLE_BYTES:
                            yield _as_batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield _as_batch(rows)

    return manifest.select("archive").repartition(max(1, manifest.count())).mapInArrow(run, _RECORD)


def _as_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(),
             "refers_to": pa.int64(), "target_uri": pa.string(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], list(kinds))
