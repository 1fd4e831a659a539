"""WARC: pages to archives, and the normaliser of monolithic gzip files.

Three steps. `write_monolithic` writes a WARC record per page behind a warcinfo record, each file one gzip
stream from end to end, and lists the records' digests. `normalise` inflates each such file once, rewrites
every record as a gzip member of its own and writes a sidecar index (JSON lines: offset, length, ordinal,
type); on the way it turns the records whose payload another record already holds into revisits.
`read_archives` reads the members back by the index's offsets.

The normaliser takes files of one gzip member or of many, in any division; a file that ends inside a member or
a record is an error, never a shorter archive. Records that don't change keep their header as it is.

Files are written beside their place and then moved there, under names that the partition alone
determines, so a task that runs again overwrites its own work. A record's id names its page, file and place,
so rows that repeat a page_id have ids of their own.

Edge cases: null html is the empty payload; null and hostile urls are percent-encoded into one header
line; null ids come back as null, after all others in the choice of the response; of rows that repeat,
the first by file and place is the response; an empty table writes no records. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.session import bounded_batches, removed, scratch, stored, table

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
LEVEL = 6
CHUNK = 1 << 18


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class _Placed:
    """A file that appears under its name only when it is whole."""

    def __init__(self, uri: str):
        self.fs, self.path = _fs(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.own = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.own, compression=None)
        self.at = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def place(self) -> None:
        self.out.close()
        self.fs.move(self.own, self.path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(value) -> str:
    """A header value: what could end the line, or isn't ASCII, is percent-encoded."""
    out = []
    for b in ("" if value is None else value).encode("utf-8", "surrogatepass"):
        out.append(chr(b) if 0x20 < b < 0x7F else f"%{b:02X}")
    return "".join(out)


def _urn(page_id, file: str, seq: int) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{file.partition('.')[0]}:{seq}>"


def _page(urn: str):
    """The page that a record's id names."""
    inner = urn[1:-1].split(":")[2]
    return None if inner == "null" else int(inner)


def _head(kind: str, urn: str, url: str, digest: str, length: int, refers: str | None = None) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {urn}", f"WARC-Target-URI: {url}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {refers}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}", "", ""]
    return "\r\n".join(lines).encode()


def _info(file: str) -> bytes:
    """The warcinfo record of a file."""
    body = b"format: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:x-archive:{file.partition('.')[0]}>", f"WARC-Date: {DATE}", f"WARC-Filename: {file}", "Content-Type: application/warc-fields", f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def _http(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def _whole(value):
    return None if pd.isna(value) else int(value)


def write_monolithic(pages: DataFrame, root: str, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Writes the files; returns file, seq, page_id, payload_bytes, payload_digest of each record, stored."""
    bounded_batches(pages.sparkSession)

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name = f"{TaskContext.get().partitionId():06d}.warc.gz"
        out = squeeze = None
        seq = 0
        for rows in batches:
            if out is None:
                out, squeeze = _Placed(f"{root}/{name}"), zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(squeeze.compress(_info(name)))
            listed = []
            for page_id, url, html in zip(rows["id"], rows["url"], rows["html"], strict=True):
                page_id = _whole(page_id)
                payload = b"" if html is None else html.encode("utf-8", "surrogatepass")
                digest, http = digest_of(payload), _http(len(payload))
                for part in (_head("response", _urn(page_id, name, seq), _line(url), digest, len(http) + len(payload)), http, payload, b"\r\n\r\n"):
                    out.write(squeeze.compress(part))
                listed.append((name, seq, page_id, len(payload), digest))
                seq += 1
            listed = pd.DataFrame(listed, columns=["file", "seq", "page_id", "payload_bytes", "payload_digest"])
            listed["page_id"] = listed["page_id"].astype("Int64")
            yield listed
        if out is not None:
            out.write(squeeze.flush())
            out.place()

    rows = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return stored(rows.mapInPandas(write, "file string, seq bigint, page_id bigint, payload_bytes bigint, payload_digest string"), "warc-records")


def revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """file, seq, refers_to (page, file, seq) of the records whose payload an earlier page holds. Only ids and digests move;
    one payload that very many pages hold is one key of the join, whose large side AQE splits."""
    rank = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "file", "seq")
    first = (
        records.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("payload_digest")
        .agg(F.min(rank).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("payload_digest", F.struct("first.page_id", "first.file", "first.seq").alias("refers_to"))
    )
    return (
        records.filter(F.col("payload_bytes") >= min_bytes)
        .join(first, "payload_digest")
        .filter("NOT (file = refers_to.file AND seq = refers_to.seq)")
        .select("file", "seq", "refers_to")
    )


def _inflated(stream) -> Iterator[bytes]:
    """The bytes of all gzip members of a stream, in blocks of at most CHUNK; zero bytes behind a member are padding."""
    member, some, rest = None, False, b""
    while rest := rest or stream.read(CHUNK):
        if member is None:
            if some and not rest.strip(b"\0"):
                rest = b""
                continue
            member, some = zlib.decompressobj(31), True
        block = member.decompress(rest, CHUNK)
        rest = member.unused_data if member.eof else member.unconsumed_tail
        if member.eof:
            member = None
        if block:
            yield block
    if member is not None or not some:
        raise ValueError("a gzip file that ends inside a member")


def _records(stream) -> Iterator[tuple[bytes, dict, bytes]]:
    """Header, its fields, and block of each record of a gzip file."""
    blocks, held, at = _inflated(stream), bytearray(), 0

    def need(n: int) -> bool:
        nonlocal at
        while len(held) - at < n:
            if (block := next(blocks, None)) is None:
                return False
            held.extend(block)
        if at > CHUNK:
            del held[:at]
            at = 0
        return True

    while need(1):
        size = CHUNK
        while (end := held.find(b"\r\n\r\n", at)) < 0:
            if not need(size) and held.find(b"\r\n\r\n", at) < 0:
                raise ValueError("a WARC record without the end of its header")
            size += CHUNK
        head = bytes(held[at : end + 4])
        fields = dict(x.split(": ", 1) for x in head[:-4].decode().split("\r\n")[1:])
        n = int(fields["Content-Length"])
        if not need(len(head) + n + 4):
            raise ValueError("a WARC record shorter than its Content-Length")
        block = bytes(held[at + len(head) : at + len(head) + n])
        at += len(head) + n + 4
        yield head, fields, block


def _normalised(source: str, target: str, changed: dict) -> tuple[int, int]:
    """One file: changed maps the ordinal of a response to the record (page, file, seq) that its revisit refers to."""
    fs, path = _fs(source)
    out, index = _Placed(target), _Placed(f"{target}.idx")
    n = seq = 0
    with fs.open_input_stream(path, compression=None) as stream:
        for head, fields, block in _records(stream):
            kind, at = fields["WARC-Type"], None
            if kind == "response":
                at, seq = seq, seq + 1
                if at in changed:
                    kind, block = "revisit", block[: block.index(b"\r\n\r\n") + 4]
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    head = _head(kind, fields["WARC-Record-ID"], fields["WARC-Target-URI"], digest, len(block), _urn(*changed[at]))
            member = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            data = member.compress(head + block + b"\r\n\r\n") + member.flush()
            index.write(json.dumps({"offset": out.at, "length": len(data), "seq": at, "type": kind}).encode() + b"\n")
            out.write(data)
            n += 1
    out.place()
    index.place()
    return n, out.at


def normalise(spark: SparkSession, files: DataFrame, changes: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites each file of `files` (column file); returns file, n_records, n_bytes, stored.

    changes: file, seq, refers_to. A file's changes are as many as its records at most."""
    per_file = changes.groupBy("file").agg(F.collect_list(F.struct("seq", "refers_to")).alias("changed"))
    listed = files.join(per_file, "file", "left")

    def rewrite(batches):
        for rows in batches:
            done = []
            for name, changed in zip(rows["file"], rows["changed"], strict=True):
                found = {int(x["seq"]): (_whole(x["refers_to"]["page_id"]), x["refers_to"]["file"], int(x["refers_to"]["seq"])) for x in ([] if changed is None else changed)}
                done.append((name, *_normalised(f"{source}/{name}", f"{target}/{name}", found)))
            yield pd.DataFrame(done, columns=["file", "n_records", "n_bytes"])

    n = max(1, min(files.count(), 4096))
    return stored(listed.repartition(n, "file").mapInPandas(rewrite, "file string, n_records bigint, n_bytes bigint"), "warc-files")


def read_archives(files: DataFrame, root: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record, by the sidecar's offsets.

    The digest of a response is computed from the payload that the member holds."""

    def read(batches):
        for rows in batches:
            for name in rows["file"]:
                fs, path = _fs(f"{root}/{name}")
                with fs.open_input_stream(f"{path}.idx", compression=None) as stream:
                    entries = [json.loads(x) for x in stream.read().splitlines()]
                found = []
                with fs.open_input_file(path) as archive:
                    for entry in entries:
                        if entry["type"] not in ("response", "revisit"):
                            continue
                        archive.seek(entry["offset"])
                        data = zlib.decompress(archive.read(entry["length"]), 31)
                        head, _, block = data.partition(b"\r\n\r\n")
                        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
                        http, _, payload = block[:-4].partition(b"\r\n\r\n") if headers["WARC-Type"] == "response" else (block, b"", b"")
                        length = int(http.split(b"Content-Length: ")[1].split(b"\r\n")[0])
                        kind = headers["WARC-Type"]
                        digest = digest_of(payload) if kind == "response" else headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        refers = _page(headers["WARC-Refers-To"]) if kind == "revisit" else None
                        found.append((_page(headers["WARC-Record-ID"]), length if kind == "revisit" else len(payload), digest, kind, refers))
                        if len(found) >= 4096:
                            yield _frame(found)
                            found = []
                if found:
                    yield _frame(found)

    n = max(1, min(files.count(), 4096))
    return files.select("file").repartition(n, "file").mapInPandas(read, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def _frame(found: list) -> pd.DataFrame:
    out = pd.DataFrame(found, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    return out.astype({"page_id": "Int64", "refers_to": "Int64"})


def archive(pages: DataFrame, root: str, min_bytes: int = 0, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Pages to normalised archives below root, the monolithic files dropped; returns the files' list."""
    spark = pages.sparkSession
    records = write_monolithic(pages, f"{root}/monolithic", id_col, url_col, html_col)
    files = normalise(spark, records.select("file").distinct(), revisits(records, min_bytes), f"{root}/monolithic", f"{root}/members")
    removed(spark, f"{root}/monolithic")
    return files


def op10_warc(spark, sf_dir):
    root = scratch(spark, "warc")
    return read_archives(archive(table(spark, sf_dir, "pages"), root), f"{root}/members")


OP10_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, unhex(sha1(html)) AS raw, sha1(html) AS hex FROM p),
bits AS (SELECT hex, list_reduce(list_transform(range(1, 33), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + (((('0x' || substr(hex, 1 + ((i - 1) // 8) * 10, 10))::BIGINT >> (35 - 5 * ((i - 1) % 8)))) & 31)::INT, 1)), lambda a, b: a || b) AS b32
  FROM (SELECT DISTINCT hex FROM d)),
f AS (SELECT hex, min(page_id) AS first FROM d GROUP BY hex)
SELECT page_id, payload_bytes, b32 AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM d JOIN bits USING (hex) JOIN f USING (hex)
"""
