"""WARC archives compressed with a Zstandard dictionary of their own records.

An archive (.warc.zst) opens with a skippable frame (magic 0x184D2A5D) that holds the dictionary;
each record follows as a frame of its own, compressed with it, so one record can be read by itself.
The dictionary is trained on the archive's first records, sample_bytes of them. Too few or too
small records to train on: the archive has no dictionary frame.

Pages with equal payloads of least_revisit bytes or more are stored once: the page with the largest
id as response, the others as revisit records that refer to it.

Each task writes archives of its own, under names that hold the task attempt, and tells their paths;
the list of paths is a written table, so a task that runs twice leaves an unlisted file and no
second copy. Files go to any store that pyarrow's file systems open by URI.

Each archive starts with a warcinfo record, which does not count among its records.

Defined results: a null payload counts as empty; a page with a null url has the record's id as its target; a null id
stays null, and such a page is a revisit if an equal page has an id; rows alike in id and payload
are alike in kind (all responses if theirs is the largest id); an empty table gives no archive and
an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from backleaf.llm.common import stage

# Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"

READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    """A page's record id; pages without an id differ by their place."""
    name = f"page:{page_id}" if page_id is not None else f"page at {place}"
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}:{digest}')}>"


def sha1_field(data: bytes) -> str:
    return f"sha1:{base64.b32encode(data).decode()}"


def info_record(place: str, date: str) -> bytes:
    """The warcinfo record that an archive starts with."""
    block = b"software: backleaf\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'archive:{place}')}>", f"WARC-Date: {date}", f"WARC-Block-Digest: {sha1_field(hashlib.sha1(block).digest())}"]
    head += ["Content-Type: application/warc-fields", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str, place: str) -> bytes:
    """One WARC record; a revisit has the HTTP header only. digest: hex SHA-1 of the payload. A page without a URL has its record's id for it."""
    block, own = HTTP_HEAD.format(len(payload)).encode() + (b"" if revisit else payload), record_id(page_id, digest, place)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {own}", f"WARC-Date: {date}"]
    head.append("WARC-Target-URI: " + (own[1:-1] if url is None else quote(url, safe="%/:?#[]@!$&'()*+,;=~-._")))
    head.append(f"WARC-Payload-Digest: {sha1_field(bytes.fromhex(digest))}")
    head.append(f"WARC-Block-Digest: {sha1_field(hashlib.sha1(block).digest())}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[int | None, int, str, str, int | None]:
    """A record as a row of READ_SCHEMA; raises if a response's payload does not have its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind, length = fields["WARC-Type"], int(http.rpartition(b"Content-Length: ")[2])
    if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (length, digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not have its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("X-Page-ID"), length, digest, kind, number("X-Refers-To-Page-ID")


def trained(samples: list[bytes], size: int, level: int) -> zstandard.ZstdCompressionDict | None:
    """A dictionary of at most `size` bytes and a tenth of the samples; None if they do not suffice."""
    size = min(size, sum(map(len, samples)) // 10)
    if len(samples) < 8 or size < 1024:
        return None
    try:
        made = zstandard.train_dictionary(size, samples, k=256, d=8, level=level)
    except zstandard.ZstdError:
        return None
    made.precompute_compress(level=level)
    return made


def frames(stream, chunk: int = 1 << 16) -> Iterator[bytes]:
    """The records of an open archive, one by one."""
    data, decompressor = stream.read(chunk), zstandard.ZstdDecompressor()
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_MAGIC:
        end = 8 + struct.unpack("<I", data[4:8])[0]
        while len(data) < end:
            if not (more := stream.read(end - len(data))):
                raise ValueError("the archive ends within its dictionary")
            data += more
        decompressor, data = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:end])), data[end:]
    while data or (data := stream.read(chunk)):
        one, out = decompressor.decompressobj(), []
        while True:
            out.append(one.decompress(data))
            if one.eof:
                data = one.unused_data
                break
            if not (data := stream.read(chunk)):
                raise ValueError("the archive ends within a record")
        yield b"".join(out)


def decided(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_revisit: int, salts: int = 16) -> DataFrame:
    """(page_id, url, payload, digest, refers_to, revisit) for each page; pages with one payload meet its row in `salts` parts."""
    payload = F.coalesce(F.col("payload"), F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[payload_col].alias("payload"))
    rows = rows.select("page_id", "url", payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).alias("n"), F.xxhash64(payload).alias("check"))
    equal = rows.where(F.col("n") >= least_revisit).groupBy("digest", "n", "check").agg(F.max("page_id").alias("keeper"), F.count("*").alias("pages"))
    equal = stage(equal.where("pages > 1 and keeper is not null").select("digest", "n", "check", "keeper"), "equal-pages")
    salted = equal.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted, ["digest", "n", "check", "salt"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return rows.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("keeper")).alias("refers_to"), revisit.alias("revisit"))


def write(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    least_revisit: int = 1000,
    date: str = "1970-01-01T00:00:00Z",
    dictionary_bytes: int = 65536,
    sample_bytes: int = 4 << 20,
    archive_bytes: int = 1 << 30,
    level: int = 3,
) -> DataFrame:
    """Writes one archive or more for each partition; returns the written table of their paths.

    The table has path, records and bytes. An archive is closed once it has archive_bytes.
    """
    def archived(batches):
        import pyarrow as pa
        from pyarrow.fs import FileSystem
        from pyspark import TaskContext

        task = TaskContext.get()
        store, top = FileSystem.from_uri(folder)
        place = f"part-{task.partitionId():06d}"
        rows = (x for b in batches for x in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit"))))
        records = (record(i, u, p.encode("utf-8", "surrogatepass"), d, r, v, date, f"{place}-{n}") for n, (i, u, p, d, r, v) in enumerate(rows))
        number = 0
        for first in records:
            samples, size = [first], len(first)
            while size < sample_bytes and (x := next(records, None)) is not None:
                samples.append(x)
                size += len(x)
            store.create_dir(top, recursive=True)
            path = f"{top}/{place}-{number:03d}-{task.taskAttemptId()}.warc.zst"
            dictionary = trained(samples, dictionary_bytes, level)
            packer, n = zstandard.ZstdCompressor(level=level, dict_data=dictionary), 0
            with store.open_output_stream(path, compression=None) as out:
                if dictionary is not None:
                    raw = dictionary.as_bytes()
                    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
                out.write(packer.compress(info_record(f"{folder}/{place}-{number:03d}", date)))
                for x in samples:
                    out.write(packer.compress(x))
                    n += 1
                del samples
                while out.tell() < archive_bytes and (x := next(records, None)) is not None:
                    out.write(packer.compress(x))
                    n += 1
                written = out.tell()
            number += 1
            uri = folder.rstrip("/") + path[len(top) :]
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([n], pa.int64()), pa.array([written], pa.int64())], names=["path", "records", "bytes"])

    return stage(decided(pages, id_col, url_col, payload_col, least_revisit).mapInArrow(archived, "path string, records long, bytes long"), "archives")


def read(archives: DataFrame) -> DataFrame:
    """The records of archives (column path), as READ_SCHEMA; a task reads an archive record by record."""
    def opened(batches):
        import pyarrow as pa
        from pyarrow.fs import FileSystem

        kinds, names = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()), [x.split()[0] for x in READ_SCHEMA.split(", ")]

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for b in batches:
            for uri in b.column("path").to_pylist():
                store, path = FileSystem.from_uri(uri)
                rows: list[tuple] = []
                with store.open_input_stream(path, compression=None) as stream:
                    for raw in frames(stream):
                        if raw.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n"):
                            continue
                        rows.append(parsed(raw))
                        if len(rows) == 5000:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    n = max(1, min(archives.count(), 10_000))
    return archives.select("path").repartition(n).mapInArrow(opened, READ_SCHEMA)
