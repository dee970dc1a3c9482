"""WARC archives with a two-level capture index.

Pages become records in gzip members of archive files; of pages with equal payloads the
one with the largest page_id is the response and the others are revisits that refer to
it. The captures are sorted by reversed-host URL key (and page_id) and written in
compressed blocks of ``BLOCK_LINES``; a sparse directory keeps the first key of every
block. A lookup searches the directory, reads one byte range of the index, then one
byte range of an archive. Pages are found by their exact key (``lookup``), by URL or by
host with its subdomains (``captures_in`` over ``ranges_of``).

Archives, index blocks and directory lie in the shared folder. A file's name holds a
random part and reaches the capture table only when its task has ended, so a retried
task leaves at most a file that nothing refers to.

Null html is an empty payload. A null url is keyed as ``~`` and its target is the page's
own id. Repeated pages are records of their own; a null page_id is never a revisit. An
empty table gives empty archives and an empty result. Other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs as files
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from raceflow import skew
from raceflow.session import cut_lineage, scratch_path

BLOCK_LINES = 256
ARCHIVE_BYTES = 256 << 20
JOIN_GAP = 64 << 10
READ_BYTES = 4 << 20
RANGE_ROWS = 50_000
END = b"\r\n\r\n"


def url_key(url: str | None) -> str:
    """``http://www.a.example.org:80/x?y#z`` → ``org,example,a)/x?y``; a null url is ``~``."""
    if url is None:
        return "~"
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url.strip()).split("#", 1)[0]
    host, slash, path = re.match(r"([^/?]*)(/?)(.*)", rest, re.S).groups()
    host = re.sub(r"^www\d*\.", "", re.sub(r":(80|443)?$", "", host.rpartition("@")[2].lower()))
    host, _, port = host.partition(":")
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")/" + path
    return re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", key)


def sort_key(url: str | None, page_id: int | None) -> str:
    """Index order: key, then page_id (null first), as one string."""
    return f"{url_key(url)} {0 if page_id is None else page_id + 2**63 + 1:020d}"


def url_range(url: str | None) -> list[tuple[str, str]]:
    """The key range [low, high) of all captures of a URL; of pages without one for null."""
    key = url_key(url)
    return [(f"{key} ", f"{key}!")]


def host_ranges(host: str) -> list[tuple[str, str]]:
    """Key ranges of a host's pages, those on other ports and those of its subdomains."""
    name = url_key(host)[:-2]
    return [(name + c, name + chr(ord(c) + 1)) for c in "):,"]


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One record as a gzip member; a revisit holds no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    target = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
            f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 2000-01-01T00:00:00Z", f"WARC-Target-URI: {target}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(body)}"]
    if refers_to is not None:
        head[2:2] = [f"WARC-Refers-To: <urn:page:{refers_to}>",
                     "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + END + body + END) + packer.flush()


def parsed(member: bytes) -> tuple:
    """(page_id, payload_bytes, digest, type, refers_to); a response's digest is made from its payload."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(END)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[:int(fields["Content-Length"])]
    http, _, payload = body.partition(END)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response":
        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest or len(payload) != size:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def number(field):
        text = fields.get(field, "None").strip("<>").removeprefix("urn:page:")
        return None if text == "None" else int(text)

    return number("WARC-Record-ID"), size, digest, kind, number("WARC-Refers-To")


def _store(folder: str):
    return files.FileSystem.from_uri(folder)


def _archive(batches, folder: str, archive_bytes: int):
    """Write the pages of a task; a row (sort_key, archive, at, length) for every record."""
    store, root = _store(folder)
    out, name, at, rows = None, "", 0, []
    for batch in batches:
        for page_id, url, html, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if out is None or at >= archive_bytes:
                if out:
                    out.close()
                name, at = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                out = store.open_output_stream(f"{root}/{name}", compression=None)
            member = record(page_id, url, (html or "").encode(), refers_to)
            out.write(member)
            rows.append((sort_key(url, page_id), name, at, len(member)))
            at += len(member)
    if out:
        out.close()
    for i in range(0, len(rows), 10_000):
        yield _captures(rows[i:i + 10_000])


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    key, name, at, length = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(name), pa.array(at, pa.int64()), pa.array(length, pa.int64())],
                                      ["key", "archive", "at", "length"])


def _blocks(batches, folder: str, block_lines: int):
    """Write sorted captures as compressed blocks; a directory row for every block."""
    store, root = _store(folder)
    name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.z"
    out, at, lines, first, found = None, 0, [], None, []

    def flush():
        nonlocal out, at, lines
        out = out or store.open_output_stream(f"{root}/{name}", compression=None)
        block = zlib.compress("\n".join(lines).encode(), 6)
        out.write(block)
        found.append((first, name, at, len(block), lines[-1].split("\t", 1)[0]))
        at, lines = at + len(block), []

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if not lines:
                first = row[0]
            lines.append("\t".join(map(str, row)))
            if len(lines) == block_lines:
                flush()
    if lines:
        flush()
    if out:
        out.close()
        yield _captures([f[:4] for f in found]).append_column("last", pa.array([f[4] for f in found], pa.string()))


def _looked_up(batches, folder: str, directory: str):
    """Captures of sorted keys: directory, block range, line; one block is held at a time."""
    store, root = _store(folder)
    for batch in batches:
        keys = batch.column(0).to_pylist()
        if not keys:
            continue
        place, path = _store(directory)
        # only the blocks that reach into the keys' range
        near = (ds.field("key") <= keys[-1]) & (ds.field("last") >= keys[0])
        table = ds.dataset(path, filesystem=place, format="parquet").to_table(filter=near)
        entries = sorted(zip(*(table.column(c).to_pylist() for c in ("key", "archive", "at", "length"))))
        firsts = [e[0] for e in entries]
        held, block, rows = None, [], []
        for key in keys:
            i = bisect.bisect_right(firsts, key) - 1
            # equal keys (repeated pages) may begin in an earlier block
            i = max(0, bisect.bisect_left(firsts, key, 0, i + 1) - 1) if i >= 0 and firsts[i] == key else i
            while 0 <= i < len(entries) and firsts[i] <= key:
                if held != i:
                    _, name, at, length = entries[i]
                    with store.open_input_file(f"{root}/{name}") as f:
                        f.seek(at)
                        lines = zlib.decompress(f.read(length)).decode().split("\n")
                    held, block = i, [line.split("\t") for line in lines]
                lo = bisect.bisect_left(block, [key])
                while lo < len(block) and block[lo][0] == key:
                    rows.append((key, block[lo][1], int(block[lo][2]), int(block[lo][3])))
                    lo += 1
                i = i + 1 if lo == len(block) else len(entries)
        if rows:
            yield _captures(rows)


def _touched(batches, directory: str):
    """Index blocks that reach into ranges, streamed from the directory."""
    place, path = _store(directory)
    blocks = ds.dataset(path, filesystem=place, format="parquet")
    for batch in batches:
        for low, high in zip(*(batch.column(i).to_pylist() for i in range(2))):
            near = (ds.field("key") < high) & (ds.field("last") >= low)
            for found in blocks.to_batches(columns=["archive", "at", "length"], filter=near):
                if found.num_rows:
                    ends = [pa.array([x] * found.num_rows, pa.string()) for x in (low, high)]
                    yield pa.RecordBatch.from_arrays([*found.columns, *ends], ["archive", "at", "length", "low", "high"])


def _inside(batches, folder: str):
    """The captures of blocks that lie in their range; one block is held at a time."""
    store, root = _store(folder)
    for batch in batches:
        for name, at, length, low, high in zip(*(batch.column(i).to_pylist() for i in range(5))):
            with store.open_input_file(f"{root}/{name}") as f:
                f.seek(at)
                lines = zlib.decompress(f.read(length)).decode().split("\n")
            rows = [line.split("\t") for line in lines]
            rows = [(key, archive, int(a), int(n)) for key, archive, a, n in rows if low <= key < high]
            if rows:
                yield _captures(rows)


def _records(batches, folder: str):
    """Records of captures sorted by archive and place; near ranges are read together."""
    store, root = _store(folder)
    for batch in batches:
        rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
        out, i = [], 0
        while i < len(rows):
            name, begin, end, j = rows[i][0], rows[i][1], rows[i][1] + rows[i][2], i + 1
            while (j < len(rows) and rows[j][0] == name and rows[j][1] <= end + JOIN_GAP and rows[j][1] - begin < READ_BYTES):
                end, j = max(end, rows[j][1] + rows[j][2]), j + 1
            with store.open_input_file(f"{root}/{name}") as f:
                f.seek(begin)
                data = f.read(end - begin)
            out += [parsed(data[at - begin:at - begin + length]) for _, at, length in rows[i:j]]
            i = j
        page, size, digest, kind, refers = zip(*out) if out else ((),) * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(page, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.string()),
             pa.array(kind, pa.string()), pa.array(refers, pa.int64())],
            ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


CAPTURE = "key string, archive string, at long, length long"
DIRECTORY = f"{CAPTURE}, last string"


def write(pages: DataFrame, folder: str, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the archives; the stored captures (key, archive, at, length)."""
    store, root = _store(folder)
    store.create_dir(root, recursive=True)
    pages = pages.select(F.col("page_id").cast("long"), "url", "html")
    body = F.coalesce(F.col("html"), F.lit(""))
    seen = pages.select("page_id", F.sha1(body).alias("digest"), F.octet_length(body).alias("size"))
    seen = seen.filter((F.col("size") >= least_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest").distinct()
    largest = seen.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    # the commonest payloads are split off if the table of repeated ones is too large to be broadcast
    revisits = skew.lookup(seen, largest, ["digest"]).filter("page_id < refers_to").select("page_id", "digest", "refers_to")
    rows = pages.withColumn("digest", F.sha1(body)).join(revisits, ["page_id", "digest"], "left")
    rows = rows.select("page_id", "url", "html", "refers_to")
    return cut_lineage(rows.mapInArrow(lambda b: _archive(b, folder, archive_bytes), CAPTURE))


def index(captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Write the index blocks; the stored directory (first key, file, at, length, last key), a row for each block."""
    many = max(1, -(-captures.count() // RANGE_ROWS))
    ordered = captures.repartitionByRange(many, "key", "archive", "at").sortWithinPartitions("key", "archive", "at")
    return cut_lineage(ordered.mapInArrow(lambda b: _blocks(b, folder, block_lines), DIRECTORY))


def lookup(keys: DataFrame, folder: str, directory: DataFrame, parts: int) -> DataFrame:
    """Captures of the rows of ``keys`` (key); each distinct key once."""
    place = directory.inputFiles()
    if not place:
        return keys.sparkSession.createDataFrame([], CAPTURE)
    place = place[0].rsplit("/", 1)[0]
    ordered = keys.distinct().repartitionByRange(parts, "key").sortWithinPartitions("key")
    return ordered.mapInArrow(lambda b: _looked_up(b, folder, place), CAPTURE)


def ranges_of(asked: DataFrame, column: str, hosts: bool = False) -> DataFrame:
    """Key ranges (low, high) of the URLs of a column, or of its hosts; a null host has none."""
    def ranges(batches):
        for batch in batches:
            values = batch.column(0).to_pylist()
            if hosts:
                found = [r for v in values if v is not None for r in host_ranges(v)]
            else:
                found = [r for v in values for r in url_range(v)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], pa.string()) for i in (0, 1)], ["low", "high"])

    return asked.select(F.col(column).cast("string")).distinct().mapInArrow(ranges, "low string, high string")


def captures_in(ranges: DataFrame, folder: str, directory: DataFrame) -> DataFrame:
    """Captures whose key lies in one of the ranges (low, high), each once however many hold it.

    A range's directory rows (one for every block) are streamed by one task; the blocks they name
    are then dealt to all tasks, so a host that has a third of all pages is read by many.
    """
    place = directory.inputFiles()
    if not place:
        return ranges.sparkSession.createDataFrame([], CAPTURE)
    place = place[0].rsplit("/", 1)[0]
    spread = ranges.distinct().repartition("low")
    blocks = spread.mapInArrow(lambda b: _touched(b, place), "archive string, at long, length long, low string, high string")
    return blocks.repartition("archive", "at").mapInArrow(lambda b: _inside(b, folder), CAPTURE).distinct()


def read(captures: DataFrame, folder: str) -> DataFrame:
    """The records of ``captures`` by range reads, near ones together."""
    spread = captures.select("archive", "at", "length").withColumn("_part", F.expr(f"at DIV {READ_BYTES}L"))
    spread = spread.repartition("archive", "_part").drop("_part").sortWithinPartitions("archive", "at")
    return spread.mapInArrow(lambda b: _records(b, folder), "page_id long, payload_bytes long, payload_digest string, "
                                                            "record_type string, refers_to long")


def _keys(batches):
    for batch in batches:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([sort_key(u, p) for u, p in pairs], pa.string())], ["key"])


def keys_of(pages: DataFrame) -> DataFrame:
    """The index key of every page (url, page_id)."""
    return pages.select("url", F.col("page_id").cast("long")).mapInArrow(_keys, "key string")


def round_trip(pages: DataFrame) -> DataFrame:
    """The contract's columns: every page written, then found by its key and read back."""
    folder = scratch_path(pages.sparkSession, "warc")
    captures = write(pages, folder)
    directory = index(captures, folder)
    parts = max(1, -(-captures.count() // RANGE_ROWS))
    return read(lookup(keys_of(pages), folder, directory, parts), folder)
