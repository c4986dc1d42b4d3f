"""WARC archives of captured pages and a two-level index to read them back.

Tasks write their pages as gzip members, one record each, and list what they wrote. The list is sorted by the reversed host and
path of the address and cut into shards of compressed blocks; a shard ends with a sparse directory, one line per block. A lookup
finds its shard, searches the directory by halves, reads the block, searches that, and reads the record's bytes only.

Files are reached with Arrow's file systems (local paths, `file:`, `hdfs:`, `s3:`, `gs:`) in the folder that all executors
share. A task that runs again writes files of its own; only files named in a finished list count.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillsight.llm.common import pieces, table
from tillsight.plans.shared import new_path, stored

#: Payloads of at least so many bytes are written once.
REVISIT_BYTES = 1000
#: An archive is closed when it has grown to this size, a new one is opened for the next record.
ARCHIVE_BYTES = 1 << 30
#: Captures of an index block, of a shard (while there are few shards) and the number of shards at most.
BLOCK_LINES = 3000
SHARD_CAPTURES = 8192
MOST_SHARDS = 4096
#: Bytes of a key kept in directories; longer keys share an entry and are told apart in the block.
KEY_BYTES = 512
#: Neighbouring records are read together up to this size and this distance.
READ_BYTES = 8 << 20
READ_GAP = 64 << 10
#: Bytes of records read by a task.
TASK_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_CONTROL = re.compile(rb"[\x00-\x20\x7f]")
_ADDRESS = re.compile(rb"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)(:\d+)?([^#]*)")

CAPTURES = "key string, file string, offset bigint, length bigint"
SHARDS = "file string, first binary, last binary, directory_offset bigint, directory_length bigint, captures bigint"


def clean_uri(url: str | None) -> bytes:
    """The address as it stands in headers: control characters and blanks escaped; empty for null."""
    return _CONTROL.sub(lambda m: b"%%%02X" % m[0][0], (url or "").encode())


def capture_key(uri: bytes) -> bytes:
    """`com,example,www)/path?query`: host reversed and lower-cased, without scheme, user and fragment; other text as it is."""
    found = _ADDRESS.match(uri)
    if not found:
        return uri
    host, port, rest = found.groups()
    return b",".join(host.lower().split(b".")[::-1]) + (port or b"") + b")" + (rest or b"/")


def _files(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(folder)


def _record_id(page: str, uri: bytes) -> str:
    return str(uuid.UUID(hashlib.md5(f"{page}:".encode() + uri).hexdigest()))


def record(page: str, uri: bytes, payload: bytes, date: str, response: tuple[str, bytes] | None) -> bytes:
    """A whole record: the response with its payload, or a revisit that names the response (page id, address)."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [f"WARC-Type: {'revisit' if response else 'response'}", f"WARC-Record-ID: <urn:uuid:{_record_id(page, uri)}>", f"WARC-Date: {date}"]
    fields += [f"Page-ID: {page}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if response:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:uuid:{_record_id(*response)}>", f"Refers-To-Page-ID: {response[0]}"]
    head = "\r\n".join(["WARC/1.1", *fields]).encode()
    head += b"\r\nWARC-Target-URI: " + uri if uri else b""
    head += b"\r\nWARC-Refers-To-Target-URI: " + response[1] if response else b""
    block = block if response else block + payload
    return head + b"\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def parsed(data: bytes) -> tuple[dict[str, bytes], bytes]:
    """Header fields (names in lower case) and payload of a whole record; a revisit has no payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    fields = {name.decode().lower(): value.strip() for name, _, value in (line.partition(b":") for line in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) != size + 4:
        raise ValueError("a WARC record is shorter or longer than it says")
    return fields, rest[:size].partition(b"\r\n\r\n")[2]


def write_archives(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least: int = REVISIT_BYTES,
    date: str = DATE,
) -> DataFrame:
    """Write one record per row and return the captures (`key`, `file`, `offset`, `length`), stored in the shared folder.

    Of rows with equal payloads of at least `least` bytes, the one with the largest id is the response, the others are
    revisits that name it. Rows that share the largest id are all responses, rows without id are revisits where another
    row has one. A null payload is empty, a null address is left out of the headers and has the empty key.
    """
    size = F.coalesce(F.octet_length("payload"), F.lit(0))
    given = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").alias("url"), F.col(f"`{payload}`").alias("payload"))
    given = given.withColumn("digest", F.when(size >= least, F.sha2("payload", 256)))
    # Copies fold before they move; only payloads that occur more than once remain.
    copies = given.where("digest is not null").groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("id", "url")).alias("response"))
    copies = stored(copies.where("n > 1 and response.id is not null").select("digest", "response"), "repeated-payloads")
    other = F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response.id"))
    rows = given.join(copies, "digest", "left").select(
        F.col("id").cast("string"),
        "url",
        F.when(other, F.col("response.id").cast("string")).alias("response_id"),
        F.when(other, F.col("response.url")).alias("response_url"),
        "payload",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        files.create_dir(path, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            for part, payloads in pieces(batch, 4):
                ids, urls, response_ids, response_urls = (part.column(i).to_pylist() for i in range(4))
                written = []
                for i, text in enumerate(payloads):
                    if out is None or at >= ARCHIVE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = files.open_output_stream(f"{path}/{name}", compression=None)
                    uri = clean_uri(urls[i])
                    response = None if response_ids[i] is None else (response_ids[i], clean_uri(response_urls[i]))
                    member = zlib.compress(record(ids[i] or "", uri, text or b"", date, response), 6, 31)
                    out.write(member)
                    written.append((capture_key(uri).decode(), name, at, len(member)))
                    at += len(member)
                kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
                columns = list(zip(*written, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["key", "file", "offset", "length"])
        if out is not None:
            out.close()

    return stored(rows.mapInArrow(run, CAPTURES), "captures")


@dataclass
class CaptureIndex:
    """Where the archives and the index lie, and the shards of the index in order: file, first and last key, place of the directory.

    The shards are at most MOST_SHARDS (more only if Spark is told to deal out more partitions), each with two keys of at most
    KEY_BYTES, whatever the number of captures.
    """

    archives: str
    folder: str
    shards: list[tuple[str, bytes, bytes, int, int]]


def build_index(captures: DataFrame, archives: str, folder: str) -> CaptureIndex:
    """Sort the captures by key into shards of compressed blocks with a sparse directory at the end of each shard.

    Captures of one key may run over blocks and shards. A block has BLOCK_LINES captures, its directory entry the first
    and last key (KEY_BYTES of each), its place and its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(folder)
        files.create_dir(path, recursive=True)
        name, out, at = f"{uuid.uuid4().hex}.cdx", None, 0
        directory: list[tuple[bytes, bytes, int, int]] = []
        lines: list[tuple[bytes, bytes]] = []
        total = 0

        def flush() -> None:
            nonlocal at, total
            data = zlib.compress(b"\n".join(key + b" " + value for key, value in lines))
            directory.append((lines[0][0][:KEY_BYTES], lines[-1][0][:KEY_BYTES], at, len(data)))
            out.write(data)
            at += len(data)
            total += len(lines)
            lines.clear()

        for batch in batches:
            for key, *place in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                out = out or files.open_output_stream(f"{path}/{name}", compression=None)
                lines.append((key.encode(), json.dumps(place).encode()))
                if len(lines) == BLOCK_LINES:
                    flush()
        if lines:
            flush()
        if out is not None:
            data = zlib.compress(json.dumps([(first.hex(), last.hex(), start, size) for first, last, start, size in directory]).encode())
            out.write(data)
            out.close()
            row = [[name], [directory[0][0]], [directory[-1][1]], [at], [len(data)], [total]]
            kinds = [pa.string(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = ["file", "first", "last", "directory_offset", "directory_length", "captures"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds, strict=True)], names=names)

    count = min(captures.count() // SHARD_CAPTURES + 1, MOST_SHARDS)
    order = ["key", "file", "offset"]
    dealt = captures.select("key", "file", "offset", "length").repartitionByRange(count, *order).sortWithinPartitions(*order)
    shards = stored(dealt.mapInArrow(run, SHARDS), "index-shards").collect()
    ordered = sorted((bytes(s["first"]), bytes(s["last"]), s["file"], s["directory_offset"], s["directory_length"]) for s in shards)
    return CaptureIndex(archives, folder, [(name, first, last, at, size) for first, last, name, at, size in ordered])


def within(firsts: list[bytes], lasts: list[bytes], key: bytes) -> range:
    """Places whose range can hold the key, found by halves; ranges are sorted and meet at most in their end keys."""
    short = key[:KEY_BYTES]
    return range(bisect_left(lasts, short), bisect_right(firsts, short))


class Shard:
    """An open shard of the index: its directory, and the block read last."""

    def __init__(self, files: pyarrow.fs.FileSystem, path: str, at: int, size: int):
        self.source = files.open_input_file(path)
        self.directory = [(bytes.fromhex(f), bytes.fromhex(e), a, n) for f, e, a, n in json.loads(zlib.decompress(self.source.read_at(size, at)))]
        self.firsts, self.lasts = [d[0] for d in self.directory], [d[1] for d in self.directory]
        self.number: int | None = None
        self.keys: list[bytes] = []
        self.places: list[bytes] = []

    def read(self, number: int) -> None:
        if number != self.number:
            _, _, at, size = self.directory[number]
            lines = [line.partition(b" ") for line in zlib.decompress(self.source.read_at(size, at)).split(b"\n")]
            self.number, self.keys, self.places = number, [line[0] for line in lines], [line[2] for line in lines]

    def find(self, key: bytes) -> Iterator[list]:
        """File, offset and length of the key's captures."""
        for number in within(self.firsts, self.lasts, key):
            self.read(number)
            for i in range(bisect_left(self.keys, key), bisect_right(self.keys, key)):
                yield json.loads(self.places[i])


def lookup(index: CaptureIndex, urls: DataFrame, url: str = "url") -> DataFrame:
    """`file`, `offset`, `length` of all captures of the addresses; repeated addresses, and such with equal keys, count once.

    Each key goes to the shards that can hold it, and a shard reads a block once for all keys in it.
    """
    if not index.shards:
        return urls.sparkSession.createDataFrame([], CAPTURES).drop("key")
    firsts, lasts = [s[1] for s in index.shards], [s[2] for s in index.shards]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [capture_key(clean_uri(u)) for u in batch.column(0).to_pylist()]
            found = [(shard, key) for key in keys for shard in within(firsts, lasts, key)]
            columns = [pa.array([s for s, _ in found], pa.int32()), pa.array([k for _, k in found], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "key"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(index.folder)
        shard, number, last = None, None, None
        for batch in batches:
            found: list[list] = []
            for own, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (own, key) == (number, last):
                    continue
                if own != number:
                    name, _, _, at, size = index.shards[own]
                    shard, number = Shard(files, f"{path}/{name}", at, size), own
                last = key
                found += shard.find(key)
            columns = list(zip(*found, strict=True)) or [()] * 3
            kinds = [pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "offset", "length"])

    asked = urls.select(F.col(f"`{url}`").alias("url")).distinct().mapInArrow(route, "shard int, key binary")
    dealt = asked.repartition(len(index.shards), "shard").sortWithinPartitions("shard", "key")
    return dealt.mapInArrow(search, "file string, offset bigint, length bigint")


def _together(places: Iterator[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Runs of neighbouring ranges that are read in one piece."""
    run: list[tuple[int, int]] = []
    for at, size in places:
        if run and (at - (run[-1][0] + run[-1][1]) > READ_GAP or at + size - run[0][0] > READ_BYTES):
            yield run
            run = []
        run.append((at, size))
    if run:
        yield run


def read_records(index: CaptureIndex, captures: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at the given places: `page_id` (text), `uri`, `record_type`, `payload_digest` (hex), `payload_bytes`, `refers_to`,
    `refers_to_uri`, and `payload` if wanted.

    Only the bytes of the records are read, neighbours together. A response whose payload does not have its digest fails the
    job. Bytes and payload of a revisit are null; `with_revisited` fills them in.
    """
    schema = "page_id string, uri string, record_type string, payload_digest string, payload_bytes bigint, refers_to string, refers_to_uri string"
    kinds = [pa.string()] * 4 + [pa.int64()] + [pa.string()] * 2 + [pa.binary()] * with_payload
    schema += ", payload binary" if with_payload else ""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _files(index.archives)
        rows = (row for batch in batches for row in zip(*(column.to_pylist() for column in batch.columns), strict=True))
        for name, places in groupby(rows, key=lambda row: row[0]):
            with files.open_input_file(f"{path}/{name}") as source:
                for near in _together((at, size) for _, at, size in places):
                    start = near[0][0]
                    data = source.read_at(near[-1][0] + near[-1][1] - start, start)
                    out = []
                    for at, size in near:
                        fields, payload = parsed(zlib.decompress(data[at - start : at - start + size], 31))
                        text = {k: v.decode() for k, v in fields.items()}
                        digest = base64.b32decode(text["warc-payload-digest"].removeprefix("sha1:")).hex()
                        revisit = text["warc-type"] == "revisit"
                        if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"payload of page {text['page-id']} does not have its digest")
                        row = [text["page-id"] or None, text.get("warc-target-uri"), text["warc-type"], digest, None if revisit else len(payload)]
                        row += [text.get("refers-to-page-id"), text.get("warc-refers-to-target-uri")]
                        out.append(row + [None if revisit else payload] * with_payload)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    spark = captures.sparkSession
    count = (captures.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES + spark.sparkContext.defaultParallelism
    dealt = captures.select("file", "offset", "length").repartitionByRange(count, "file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, schema)


def with_revisited(index: CaptureIndex, records: DataFrame) -> DataFrame:
    """Records with bytes (and payload) of revisits taken from the response they name, which is looked up and read once.

    `records` should be a stored table. A revisit whose response is not there, or has another digest, fails the job.
    """
    with_payload = "payload" in records.columns
    asked = records.where("record_type = 'revisit'").select("refers_to_uri").distinct()
    places = stored(lookup(index, asked, "refers_to_uri"), "revisited-captures")
    full = read_records(index, places, with_payload).where("record_type = 'response'")
    values = ["payload_bytes"] + ["payload"] * with_payload
    # Responses that share their id have equal payloads where a revisit names them by id and digest.
    full = full.groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(*(F.first(v).alias(f"full_{v}") for v in values))
    wanted = records.where("record_type = 'revisit'").select("refers_to", "payload_digest").distinct()
    full = stored(wanted.join(full, ["refers_to", "payload_digest"]), "revisited-payloads")
    joined = records.join(full, ["refers_to", "payload_digest"], "left")
    lost = F.raise_error(F.concat(F.lit("no response for the revisit of page "), F.coalesce("page_id", F.lit("(none)"))))
    revisit = F.col("record_type") == "revisit"
    filled = {v: F.when(~revisit, F.col(v)).when(F.col("full_payload_bytes").isNull(), lost.cast(records.schema[v].dataType)).otherwise(F.col(f"full_{v}")) for v in values}
    return joined.withColumns(filled).select(records.columns)


def archived(pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = REVISIT_BYTES) -> CaptureIndex:
    """Write the archives of the pages and their index into new places of the shared folder."""
    spark = pages.sparkSession
    archives, folder = new_path(spark, "archives"), new_path(spark, "index")
    captures = write_archives(pages, archives, page_id, url, payload, least)
    return build_index(captures, archives, folder)


def through_archives(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = REVISIT_BYTES, with_payload: bool = True
) -> DataFrame:
    """Write every page to WARC archives and read all of them back by their addresses: one row per page.

    Columns as in `read_records`, with the id in its own type and bytes (and payload) of revisits filled in. Null and empty
    payloads give responses without bytes. Null addresses, addresses without scheme, with blanks or of any length are keys like
    any other, repeated addresses share one. Repeated rows are records of their own (with one record id). Null ids stay null.
    Only the three columns are read; an empty table gives an empty result.
    """
    index = archived(pages, page_id, url, payload, least)
    records = stored(read_records(index, stored(lookup(index, pages, url), "found-captures"), with_payload), "records")
    kind = pages.schema[page_id].dataType
    return with_revisited(index, records).withColumns({"page_id": F.col("page_id").cast(kind), "refers_to": F.col("refers_to").cast(kind)})


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, digest and kind of every page's record, as read back from the archives."""
    found = through_archives(table(spark, sf_dir, "pages"), with_payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP12_SQL = f"""
with given as (
    select page_id, coalesce(html, '') as payload, strlen(coalesce(html, '')) as n from pages
), latest as (
    select payload, max(page_id) as response from given where n >= {REVISIT_BYTES} group by payload
)
select page_id, n as payload_bytes, sha1(payload) as payload_digest,
    case when response is not null and page_id is distinct from response then 'revisit' else 'response' end as record_type,
    case when response is not null and page_id is distinct from response then response end as refers_to
from given left join latest using (payload)
"""
