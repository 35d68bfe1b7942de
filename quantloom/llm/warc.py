"""WARC archives compressed with a dictionary.

A Zstandard dictionary is trained on records of the corpus, embedded in a skippable frame at the head of every
archive, and every record is a frame of its own, so one record can be read without those before it. A record whose
payload was already archived is a revisit: headers only, and a reference to the response.

Tasks write archives of bounded size to the shared folder under a temporary name and rename them when they are
whole, so a task that is run again leaves the same files. The table of archives is written before they are read.

Results for odd input: a null html is an empty payload; a null url leaves the header out; a null page id is
written without one and refers or is referred to as null; rows that repeat the smallest id of a payload are
responses all; an empty table makes no archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from quantloom.llm.common import shared_dir, store, write_out

#: Magic number of the dictionary's skippable frame (fixed by the format).
DICTIONARY_FRAME = 0x184D2A5D
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    level: int = 3
    dictionary_bytes: int = 64 << 10
    #: the dictionary is trained on distinct payloads drawn evenly by their hash, of about so many bytes together and
    #: twice as many at most; of a payload its first sixteenth of so many bytes
    sample_bytes: int = 4 << 20
    archive_bytes: int = 32 << 20
    min_revisit_bytes: int = 0


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, name: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{name}')}>"


def _headers(fields: list[tuple[str, object]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None).encode() + b"\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, refers: int | None, revisit: bool, name: str) -> bytes:
    """One uncompressed record. ``name`` makes the id of a revisit unique."""
    own = digest(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"),
              ("WARC-Record-ID", record_id("revisit", name) if revisit else record_id("page", page_id)),
              ("WARC-Date", _DATE), ("WARC-Target-URI", None if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")),
              ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{own}"),
              ("X-Page-Id", page_id)]
    if revisit:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id("page", refers)), ("X-Refers-To-Page-Id", refers)]
    return _headers(fields + [("Content-Length", len(block))]) + block + b"\r\n\r\n"


def train(samples: list[bytes], archive: Archive) -> bytes:
    """A dictionary of the samples, or nothing where they are too few to train on."""
    try:
        return zstandard.train_dictionary(archive.dictionary_bytes, samples, k=1024, d=8).as_bytes()
    except zstandard.ZstdError:
        return b""


class Writer:
    """Archives of one task: name-00000.warc.zst and on."""

    def __init__(self, folder: str, name: str, attempt: str, dictionary: bytes, archive: Archive):
        self.fs, self.folder = store(folder)
        self.name, self.attempt, self.archive, self.dictionary = name, attempt, archive, dictionary
        own = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.zstd = zstandard.ZstdCompressor(level=archive.level, write_content_size=True, write_checksum=True, **own)
        self.made, self.out = 0, None

    def _open(self) -> None:
        self.file = f"{self.name}-{self.made:05d}.warc.zst"
        self.made += 1
        self.out = self.fs.open_output_stream(f"{self.folder}/.{self.file}.{self.attempt}", compression=None)
        self.size, self.records = 0, 0
        if self.dictionary:
            self._put(struct.pack("<II", DICTIONARY_FRAME, len(self.dictionary)) + self.dictionary)
        info = b"software: quantloom\r\nformat: WARC File Format 1.1\r\n"
        self._put(self.zstd.compress(_headers([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("info", self.file)), ("WARC-Date", _DATE),
                                               ("Content-Type", "application/warc-fields"), ("Content-Length", len(info))]) + info + b"\r\n\r\n"))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def add(self, data: bytes) -> Iterator[tuple]:
        if self.out is None:
            self._open()
        self._put(self.zstd.compress(data))
        self.records += 1
        if self.size >= self.archive.archive_bytes:
            yield self.close()

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        self.fs.move(f"{self.folder}/.{self.file}.{self.attempt}", f"{self.folder}/{self.file}")
        return self.file, self.records, self.size


def samples(keyed: DataFrame, payloads: DataFrame, archive: Archive) -> list[bytes]:
    """Records to train on: an even draw over the distinct payloads; a corpus of any size and any repeats gives about sample_bytes."""
    piece = max(1, archive.sample_bytes // 16)
    total = payloads.agg(F.sum(F.least("size", F.lit(piece)).cast("bigint"))).first()[0] or 0
    share = min(1.0, archive.sample_bytes / max(total, 1))
    drawn = (keyed.filter(F.pmod(F.xxhash64("sha"), F.lit(1 << 40)) <= int(share * (1 << 40)))
             .groupBy("sha").agg(F.min(F.struct("page_id", "url")).alias("of"), F.first(F.substring(F.encode("html", "utf-8"), 1, piece)).alias("piece")))
    out, held = [], 0
    for r in drawn.orderBy("sha").toLocalIterator():
        out.append(record(r["of"].page_id, r["of"].url, bytes(r["piece"]), None, False, "")[:2 * piece])
        held += len(out[-1])
        if held >= 2 * archive.sample_bytes:
            break
    return out


def write_archives(pages: DataFrame, archive: Archive = Archive(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[str, DataFrame]:
    """Writes every row as a record; gives the folder and the table of archives (file, records, bytes)."""
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    size = F.octet_length("html")
    keyed = rows.withColumn("sha", F.sha1(F.encode("html", "utf-8"))).withColumn("size", size)
    payloads = write_out(keyed.groupBy("sha", "size").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")), "payloads")
    dictionary = train(samples(keyed, payloads, archive), archive)
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    first = payloads.filter((F.col("size") >= archive.min_revisit_bytes) & (F.col("n") > 1)).select("sha", "size", "first_id")
    joined = keyed.join(first, ["sha", "size"], "left").select("page_id", "url", "html", "first_id")

    def run(batches):
        context = TaskContext.get()
        writer = Writer(folder, f"part-{context.partitionId():06d}", str(context.taskAttemptId()), dictionary, archive)
        n, made = 0, []
        for batch in batches:
            for page_id, url, html, first_id in zip(*(c.to_pylist() for c in batch.columns)):
                n += 1
                revisit = first_id is not None and page_id != first_id
                made += writer.add(record(page_id, url, html.encode(), first_id, revisit, f"{context.partitionId()}-{n}"))
        if writer.out is not None:
            made.append(writer.close())
        yield pa.RecordBatch.from_pylist([dict(zip(("file", "records", "bytes"), m)) for m in made],
                                         schema=pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    fs, path = store(folder)
    fs.create_dir(path)
    return folder, write_out(joined.mapInArrow(run, "file string, records bigint, bytes bigint"), "archives")


def frames(read, chunk: int = 8192) -> Iterator[bytes]:
    """The content of each frame of an archive; ``read(n)`` gives its bytes. The dictionary is taken from the file."""
    head = read(8)
    rest, zstd = head, None
    if len(head) == 8:
        magic, size = struct.unpack("<II", head)
        if magic == DICTIONARY_FRAME:
            data = read(size)
            if data[:4] == b"\x28\xb5\x2f\xfd":  # the dictionary may be compressed itself
                data = zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 27)
            zstd, rest = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data)), b""
    zstd = zstd or zstandard.ZstdDecompressor()
    while rest or (rest := read(chunk)):
        frame, out = zstd.decompressobj(), []
        while True:
            out.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            rest = read(chunk)
            if not rest:
                raise ValueError("the archive ends within a record")
        yield b"".join(out)


_FIELD = re.compile(rb"([^:\r\n]+):[ ]?([^\r\n]*)\r\n")


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the block."""
    end = data.index(b"\r\n\r\n") + 4
    fields = {k.decode().lower(): v.decode() for k, v in _FIELD.findall(data[:end])}
    return fields, data[end:end + int(fields["content-length"])]


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """A row per page record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, digest_ok.

    ``payload`` is null for revisits, whose length and digest the headers give.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("digest_ok", pa.bool_())])

    def number(x):
        return None if x is None else int(x)

    def rows(file):
        fs, path = store(folder)
        with fs.open_input_stream(f"{path}/{file}", compression=None, buffer_size=1 << 20) as f:
            for data in frames(f.read):
                fields, block = parse(data)
                kind = fields["warc-type"]
                if kind == "warcinfo":
                    continue
                http, _, payload = block.partition(b"\r\n\r\n")
                told = int(re.search(rb"Content-Length: (\d+)", http)[1])
                own = fields["warc-payload-digest"].removeprefix("sha1:")
                yield {"page_id": number(fields.get("x-page-id")), "url": fields.get("warc-target-uri"), "payload_bytes": told, "payload_digest": own,
                       "record_type": kind, "refers_to": number(fields.get("x-refers-to-page-id")), "payload": payload if kind == "response" else None,
                       "digest_ok": digest(payload) == own and len(payload) == told if kind == "response" else None}

    def run(batches):
        for batch in batches:
            for file in batch.column("file").to_pylist():
                held = []
                for row in rows(file):
                    held.append(row)
                    if len(held) == 256:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema=schema)

    return archives.select("file").repartition(max(1, archives.sparkSession.sparkContext.defaultParallelism * 4), "file").mapInArrow(
        run, "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary, digest_ok boolean")
