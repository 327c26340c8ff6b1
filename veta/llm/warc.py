"""WARC archives of web pages, and their deduplication by revisit records.

Archives are gzip files of one member a record (WARC 1.1), written by the tasks through
`pyarrow.fs` into the folder the cluster shares. A task writes each file under a name of its own
and reports it only when it is closed; the reports are stored, so files of lost or repeated
attempts belong to no archive and are never read. A report lists sections of a file, each a run
of whole records of some MB; sections are what tasks read, so no archive and no payload is ever
whole in one task unless it is a single record.

Deduplication shuffles headers only: (section, offset, id, payload digest, length). Among records
of equal payloads of `least` bytes or more the one of the smallest page id (no id last, then by
place) becomes the response, the others revisit it; a revisit that came in with the archives is
joined to the original of its digest as well. Digests that very many records share are at most
some thousand by construction; their originals are broadcast and never shuffled against. The new
archives are written section by section from the old ones with fresh headers.

Reading back hashes every payload again and fails on a digest, a length or a frame that is wrong.
A null html is an empty payload; a null page id or url leaves its header out (page id and url are
null when read). Control characters, blanks and non-ASCII of a url are percent-encoded. Repeated
rows are records of their own. An empty table writes no archive.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veta.llm.text import shared_folder, store

SECTION = 4 << 20  # compressed bytes after which a section ends
ARCHIVE = 256 << 20  # compressed bytes after which a file ends
PIECE = 1 << 20  # bytes read or unpacked at a time
LEVEL = 1  # of zlib
TASKS = 10_000  # most tasks of one job over sections
HEAVY = 1024  # a digest is heavy from this share of all records on, so fewer than so many are
HEAVY_LEAST = 10_000
DATE = "2000-01-01T00:00:00Z"  # the tables know no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

SECTIONS = "file string, start bigint, stop bigint, records bigint"
HEADERS = "file string, start bigint, stop bigint, offset bigint, record_id string, type string, page_id bigint, url string, digest string, bytes bigint, refers_id string"


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record: version, named fields, an empty line, the block and two line ends."""
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode("ascii") + b"\r\n" + block + b"\r\n\r\n"


def _common(kind: str, record_id: str, page_id: int | None, url: str | None, digest: str, n: int) -> list[tuple[str, str]]:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]<>\"{}|\\^`-._", errors="surrogatepass")))
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    return [*fields, ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(n)), ("Content-Type", "application/http; msgtype=response")]


def response(record_id: str, page_id: int | None, url: str | None, payload: bytes) -> bytes:
    digest = hashlib.sha256(payload).hexdigest()
    return record(_common("response", record_id, page_id, url, digest, len(payload)), HTTP + payload)


def revisit(record_id: str, page_id: int | None, url: str | None, digest: str, n: int, refers_id: str) -> bytes:
    fields = _common("revisit", record_id, page_id, url, digest, n)
    return record([*fields, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_id}>")], HTTP)


def _place(path: str) -> tuple[pafs.FileSystem, str]:
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))


class Archive:
    """Files of one task: records are appended, finished sections come out as rows."""

    def __init__(self, folder: str, section: int = SECTION, most: int = ARCHIVE):
        self.section, self.most = section, most
        self.fs, self.path = _place(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.folder, self.out, self.name = folder, None, ""
        self.ready: list[tuple] = []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
            self.at = self.start = self.records = 0
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        packed = packer.compress(data) + packer.flush()
        self.out.write(packed)
        self.at += len(packed)
        self.records += 1
        if self.at - self.start >= self.section:
            self._cut()
            if self.at >= self.most:
                self.close()

    def _cut(self) -> None:
        if self.records:
            self.ready.append((f"{self.folder}/{self.name}", self.start, self.at, self.records))
            self.start, self.records = self.at, 0

    def close(self) -> None:
        if self.out is not None:
            self._cut()
            self.out.close()
            self.out = None

    def sections(self) -> Iterator[pa.RecordBatch]:
        """All sections; the files are whole before any is reported."""
        self.close()
        if self.ready:
            columns = zip(zip(*self.ready, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["file", "start", "stop", "records"])


def members(file: str, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the gzip members in [start, stop)."""
    fs, path = _place(file)
    with fs.open_input_file(path) as source:
        source.seek(start)
        at, left, rest = start, stop - start, b""
        while left or rest:
            unpacker, parts, begin = zlib.decompressobj(31), [], at
            while not unpacker.eof:
                if not rest:
                    rest = source.read(min(PIECE, left))
                    if not rest:
                        raise ValueError(f"{file}: record at {begin} is cut short")
                    left -= len(rest)
                parts.append(unpacker.decompress(rest))
                at += len(rest) - len(unpacker.unused_data)
                rest = unpacker.unused_data
            yield begin, b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Fields (names in lower case) and block of a record; its frame must be right."""
    head, found, body = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not found or not version.startswith(b"WARC/1."):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines:
        name, _, value = line.decode("utf-8").partition(":")
        fields[name.strip().lower()] = value.strip()
    n = int(fields["content-length"])
    if len(body) != n + 4 or body[n:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')}: length is not {n}")
    return fields, body[:n]


def _payload(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def _checked(fields: dict[str, str], block: bytes) -> tuple[str | None, int | None]:
    """Digest and length of the payload a record stands for; a response must carry it."""
    named = fields.get("warc-payload-digest", "")
    if fields["warc-type"] == "response":
        payload = _payload(block)
        digest = hashlib.sha256(payload).hexdigest()
        if named.startswith("sha256:") and named != f"sha256:{digest}":
            raise ValueError(f"record {fields['warc-record-id']}: payload has another digest")
        return digest, len(payload)
    n = fields.get("x-payload-length")
    return (named.removeprefix("sha256:") or None) if fields["warc-type"] == "revisit" else None, n and int(n)


def _folder(df: DataFrame) -> str:
    return f"{shared_folder(df.sparkSession)}/warc-{uuid.uuid4().hex}"


def write_archives(pages: DataFrame, section: int = SECTION, most: int = ARCHIVE) -> DataFrame:
    """Every row (page_id, url, html) as a response record; returns the sections written."""
    folder = _folder(pages)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = Archive(folder, section, most)
        for batch in batches:
            for page_id, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                archive.add(response(uuid.uuid4().urn, page_id.as_py(), url.as_py(), payload))
        yield from archive.sections()

    return store(pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(write, SECTIONS))


def _dealt(sections: DataFrame) -> DataFrame:
    """Sections over as many tasks as there are, up to TASKS."""
    return sections.repartition(max(1, min(TASKS, sections.count())), "file", "start")


def read_headers(sections: DataFrame) -> DataFrame:
    """One row per record: place, ids, type, digest and length of the payload (hashed again)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in HEADERS.split(", ")]
        types = [pa.int64() if f.endswith("bigint") else pa.string() for f in HEADERS.split(", ")]
        for batch in batches:
            for row in batch.to_pylist():
                rows = []
                for offset, data in members(row["file"], row["start"], row["stop"]):
                    fields, block = parse(data)
                    page_id = fields.get("x-page-id")
                    refers = fields.get("warc-refers-to")
                    rows.append((
                        row["file"], row["start"], row["stop"], offset, fields["warc-record-id"].strip("<>"), fields["warc-type"],
                        None if page_id is None else int(page_id), fields.get("warc-target-uri"), *_checked(fields, block), refers and refers.strip("<>"),
                    ))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return _dealt(sections).mapInArrow(read, HEADERS)


def with_original(headers: DataFrame, originals: DataFrame, key: str, n: int) -> DataFrame:
    """Each header with the original of its key, if any (column `original`).

    `originals` has (key, original, copies), one row a key. Keys of at least a 1/HEAVY-th of all
    n records are HEAVY at most: these few rows are broadcast, and the records that bear them
    never meet in a task. All others are joined by a shuffle.
    """
    heavy = F.col("copies") >= max(HEAVY_LEAST, -(-n // HEAVY))
    few = originals.filter(heavy).select(key, F.col("original").alias("_few"))
    first = headers.join(F.broadcast(few), key, "left")
    settled = first.filter(F.col("_few").isNotNull()).withColumnRenamed("_few", "original")
    other = originals.filter(~heavy).select(key, "original")
    return settled.unionByName(first.filter(F.col("_few").isNull()).drop("_few").join(other, key, "left"))


def deduplicate(sections: DataFrame, least: int = 100) -> DataFrame:
    """New archives in which equal payloads of `least` bytes or more are kept once; returns their sections."""
    headers = store(read_headers(sections))
    place = F.struct(F.col("page_id").isNull().alias("no_id"), "page_id", "file", "offset", "record_id")
    originals = store(
        headers.filter(F.col("bytes") >= least).filter("digest IS NOT NULL").groupBy("digest")
        .agg(F.min(F.when(F.col("type") == "response", place)).alias("original"), F.count("*").alias("copies"))
        .filter((F.col("copies") > 1) & F.col("original").isNotNull())
    )
    joined = with_original(headers, originals, "digest", headers.count())
    revisits = F.col("original").isNotNull() & (F.col("original.record_id") != F.col("record_id"))
    fresh = joined.select("file", "start", "stop", "offset", F.when(revisits, F.col("original.record_id")).alias("refers_id"), "type", F.col("refers_id").alias("old_id"))
    folder = _folder(sections)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, source = Archive(folder), None
        at = None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["file"], row["start"]) != at:
                    at = row["file"], row["start"]
                    source = members(row["file"], row["start"], row["stop"])
                offset, data = next(source)
                if offset != row["offset"]:
                    raise ValueError(f"{row['file']}: no record decided at {offset}")
                fields, block = parse(data)
                page_id, record_id = fields.get("x-page-id"), fields["warc-record-id"].strip("<>")
                page_id = None if page_id is None else int(page_id)
                refers = row["refers_id"] or (row["old_id"] if row["type"] == "revisit" else None)
                if row["type"] not in ("response", "revisit"):
                    archive.add(data)
                elif refers is None:
                    archive.add(response(record_id, page_id, fields.get("warc-target-uri"), _payload(block)))
                else:
                    digest, n = _checked(fields, block)
                    archive.add(revisit(record_id, page_id, fields.get("warc-target-uri"), digest, n, refers))
        yield from archive.sections()

    tasks = max(1, min(TASKS, sections.count()))
    decided = fresh.repartition(tasks, "file", "start").sortWithinPartitions("file", "start", "offset")
    return store(decided.mapInArrow(write, SECTIONS))


def resolved(sections: DataFrame) -> DataFrame:
    """Records of deduplicated archives, revisits joined to their responses.

    (page_id, url, payload_bytes, payload_digest, record_type, refers_to); a revisit whose
    response is not among the archives has a null refers_to.
    """
    headers = store(read_headers(sections).filter(F.col("type").isin("response", "revisit")))
    revisits, responses = headers.filter(F.col("type") == "revisit"), headers.filter(F.col("type") == "response")
    asked = revisits.groupBy("refers_id").agg(F.count("*").alias("copies"))
    known = responses.select(F.col("record_id").alias("refers_id"), F.struct("page_id", "bytes").alias("original"))
    originals = store(asked.join(known, "refers_id"))
    found = with_original(revisits, originals, "refers_id", headers.count())
    columns = ["page_id", "url", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type")]
    plain = responses.select(*columns, F.col("bytes").alias("payload_bytes"), F.lit(None).cast("bigint").alias("refers_to"))
    joined = found.select(*columns, F.coalesce("original.bytes", "bytes").alias("payload_bytes"), F.col("original.page_id").alias("refers_to"))
    return plain.unionByName(joined).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
