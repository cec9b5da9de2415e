"""WARC archives: writing, normalising monolithic gzip streams, reading single records by offset.

Archives and sidecar indexes are files in a folder that driver and executors share; file systems
are those that Arrow opens (local and network paths, HDFS, object stores).
"""

import base64
import hashlib
import json
import posixpath
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, functions as F

from corpuscope.llm.common import new_folder
from corpuscope.sources.io import reliable_checkpoint

REVISIT_PROFILE = "http://netpreservefoundation.org/warc/1.1/revisit/identical-payload-digest"
GZIP, LEVEL, CHUNK = 31, 6, 1 << 20
INDEX_SCHEMA = "file string, offset long, length long, record_id string"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def opened(path: str):
    return pafs.FileSystem.from_uri(path)


def replace_file(path: str, write) -> None:
    """``write(stream)`` into a name of this attempt's own, then move it; a retried task leaves no half file."""
    fs, name = opened(path)
    fs.create_dir(posixpath.dirname(name), recursive=True)
    own = f"{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        write(out)
    fs.move(own, name)


def header(fields: list[tuple[str, object]]) -> bytes:
    lines = "".join(f"{k}: {' '.join(str(v).split())}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode()


def record(row: dict, date: str) -> bytes:
    """One record: the response with its payload, or a revisit that only names the response."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row["payload"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode() + payload
    return header([
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date),
        ("WARC-Target-URI", row["url"]), ("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"),
        ("WARC-Profile", REVISIT_PROFILE if revisit else None), ("X-Page-Id", row["page_id"]), ("X-Refers-To-Page", row["refers_to"]),
        ("X-Payload-Length", row["payload_bytes"]), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block)),
    ]) + block + b"\r\n\r\n"


def inflated(stream, chunk: int = CHUNK):
    """Bytes of a gzip stream of any number of members, in bounded pieces."""
    member, rest = zlib.decompressobj(GZIP), b""
    while data := rest or stream.read(chunk):
        yield (piece := member.decompress(data, 4 * chunk))
        rest = member.unconsumed_tail
        if member.eof:
            rest, member = member.unused_data, zlib.decompressobj(GZIP)
        elif not piece and not rest and len(data) < chunk:
            continue
    if tail := member.flush():
        yield tail


def split_records(pieces):
    """Whole records of a stream of bytes."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(fields(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("the archive ends inside a record")


def fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_kinds(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, payload, payload_bytes, record_type and refers_to of every page.

    Payloads are equal when length, SHA-1 and SHA-256 are.  Only digests are grouped; payloads meet
    their group's one row in a join that can split a group of copies of any size.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("payload_bytes"), F.unhex(F.sha2("payload", 256)).alias("content"))
    newest = given.groupBy("content").agg(F.max("page_id").alias("newest"))
    response = F.col("page_id").eqNullSafe(F.col("newest")) | (F.col("payload_bytes") < min_bytes)
    return given.join(newest, "content").select(
        "page_id", "url", F.when(response, F.col("payload")).alias("payload"), "payload_bytes", F.sha1("payload").alias("sha1"),
        F.when(response, "response").otherwise("revisit").alias("record_type"), F.when(~response, F.col("newest")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, date: str = "2020-01-01T00:00:00Z") -> DataFrame:
    """Write each partition of ``record_kinds`` as one monolithic gzip stream; gives (file, n_records).

    A partition without rows writes nothing."""
    def write(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        first = next(rows, None)
        if first is None:
            return
        path, n = f"{folder}/mono-{uuid.uuid4().hex}.warc.gz", 0

        def stream(out):
            nonlocal n
            packer, row = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP), first
            while row is not None:
                row["payload_digest"] = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
                out.write(packer.compress(record(row, date)))
                n, row = n + 1, next(rows, None)
            out.write(packer.flush())

        replace_file(path, stream)
        yield pa.RecordBatch.from_pylist([{"file": path, "n_records": n}])

    return reliable_checkpoint(records.mapInArrow(write, "file string, n_records long"))


def normalise(files: DataFrame, folder: str, delete_source: bool = False) -> DataFrame:
    """Rewrite every record of the archives in ``files`` (file) as a gzip member of its own.

    Each archive is inflated once, from start to end, in bounded pieces; its records become members
    of ``<name>`` in ``folder`` and their places go to ``<name>.idx`` beside it, one JSON line each.
    The index is moved into place last, so a task that is run again goes on from a finished index;
    only then ``delete_source`` removes the archive it came from.
    Empty archives give no records; one that ends inside a record is an error.  Null file names are
    left out.  Gives the index (file, offset, length, record_id).
    """
    def rewrite(batches):
        for source in (x for batch in batches for x in batch.column("file").to_pylist()):
            fs, name = opened(source)
            target = f"{folder}/{posixpath.basename(name).replace('mono-', 'part-')}"
            out_fs, index = opened(f"{target}.idx")
            if out_fs.get_file_info(index).type == pafs.FileType.NotFound:
                places = []

                def members(out, fs=fs, name=name, places=places, target=target):
                    offset = 0
                    with fs.open_input_stream(name, compression=None) as stream:
                        for raw in split_records(inflated(stream)):
                            packer = zlib.compressobj(LEVEL, zlib.DEFLATED, GZIP)
                            member = packer.compress(raw) + packer.flush()
                            out.write(member)
                            head = fields(raw[:raw.find(b"\r\n\r\n")])
                            places.append({"file": target, "offset": offset, "length": len(member), "record_id": head.get("warc-record-id")})
                            offset += len(member)

                replace_file(target, members)
                replace_file(f"{target}.idx", lambda out, places=places: out.write("".join(json.dumps(p) + "\n" for p in places).encode()))
            if delete_source and fs.get_file_info(name).type != pafs.FileType.NotFound:
                fs.delete_file(name)
            with out_fs.open_input_stream(index) as stream:
                places = [json.loads(line) for line in stream.read().splitlines()]
            for i in range(0, len(places), 10_000):
                yield pa.RecordBatch.from_pylist(places[i:i + 10_000])

    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number given is not merged for being small
    return files.where("file is not null").select("file").repartition(tasks, "file").mapInArrow(rewrite, INDEX_SCHEMA)


def read_records(index: DataFrame) -> DataFrame:
    """Parse the records at the places that ``index`` names, by reading those bytes alone."""
    def read(batches):
        path, source = None, None
        for batch in batches:
            out = []
            for place in batch.to_pylist():
                if place["file"] != path:
                    path = place["file"]
                    fs, name = opened(path)
                    source = fs.open_input_file(name)
                source.seek(place["offset"])
                raw = zlib.decompress(source.read(place["length"]), GZIP)
                end = raw.find(b"\r\n\r\n")
                head, block = fields(raw[:end]), raw[end + 4:-4]
                payload = block[block.find(b"\r\n\r\n") + 4:] if head["warc-type"] == "response" else None
                number = lambda key: int(head[key]) if key in head else None
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if payload is not None and base32_sha1(payload) != digest:
                    raise ValueError(f"record {place['record_id']} doesn't match its digest")
                out.append({"page_id": number("x-page-id"), "payload_bytes": number("x-payload-length"), "payload_digest": digest,
                            "record_type": head["warc-type"], "refers_to": number("x-refers-to-page"),
                            "url": head.get("warc-target-uri"), "payload": payload})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=records)

    records = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                         ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])
    return index.mapInArrow(read, RECORD_SCHEMA)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC, normalise the archives and read all records back.

    Of equal payloads of at least ``min_bytes`` bytes the one with the largest page_id is the response
    and the others are revisits of it; repeated rows with that id are responses too, as is every row of
    a group whose ids are all null.  Null html is an empty payload; null urls and ids are left out of
    the record and read back as null.  An empty table writes no file.  Other columns are not read.
    """
    spark = pages.sparkSession
    written = write_archives(record_kinds(pages, min_bytes), new_folder(spark, "warc-stream"))
    index = reliable_checkpoint(normalise(written, new_folder(spark, "warc"), delete_source=True))
    return read_records(index)
