"""WARC archives of web pages with a two-level capture index, written and read by Spark tasks.

**Archives.** Every capture becomes one gzip member of an archive file: a ``response`` with its payload,
or a ``revisit`` that refers to the response of the same payload (equal SHA-256 and length), the one of
the smallest page id. Which captures are revisits is settled on narrow rows, counted before the shuffle;
payloads are shuffled once, on the unique capture number. A task writes files under a name of its own and
returns a row per record, and only rows of finished tasks reach the index: what a lost or repeated task
has written is never referred to.

**Index.** Captures are sorted by (reversed-host URL key, capture number) across the cluster. Each index
part holds compressed blocks of ``BLOCK`` lines and, behind them, its sparse directory: first key, place
and length of every block. The list of parts (first and last key of each, ``MAX_PARTS`` at most whatever
the corpus) is all that leaves the executors.

**Reading.** ``lookup`` finds the parts of each asked key by binary search in that list, and in a part
its blocks by binary search in the directory; only those blocks are read by range, and searched again.
``read`` fetches records by range, neighbours together, and parses them.

Files go to the folder given, through pyarrow's file systems, so executors need to reach it as the
driver does.

Defined results: null html is an empty payload; equal payloads (empty ones too) share one response, and
of repeated rows of the smallest id one is it; null ids sort last and are read back as null; a null URL
has the empty key, and spaces and control characters of a URL are percent-encoded in the header; pages
of any size are kept whole; an empty table gives empty archives, index and results; other columns of
``pages`` are not used.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import itertools
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starweave.llm.common import col, stored
from starweave.session import scratch_path, strip_scheme

BLOCK = 3_000  # index lines in a compressed block
PART_LINES = 300_000  # index lines in a part, unless that makes more than MAX_PARTS parts
MAX_PARTS = 10_000
ARCHIVE_BYTES = 1 << 30  # an archive file is closed beyond this size
_READ_BYTES = 8 << 20  # read at once at most, unless one record is longer
_GAP = 64 << 10  # bytes between two wanted records that are read along
_SPAN = 64 << 20  # bytes of one archive that a reading task takes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ODD = re.compile(r"[\x00-\x20\x7f]")


def store_of(root: str) -> tuple[FileSystem, str]:
    """The file system and path of a folder; a ``file:`` URI may have one slash or three."""
    return FileSystem.from_uri(strip_scheme(root))


#: Host, port, path with query; scheme, user and fragment are left out.
_URL = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.\-]*://)?(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^:/?#]*)(?::(\d*))?[^/?#]*([^#]*)"


def url_key(url: Column) -> Column:
    """Reversed host, ``)``, port if it is not the usual one, path and query; a null or empty URL has the empty key."""
    host, port, path = (F.regexp_extract(url, _URL, i) for i in (1, 2, 3))
    host = F.when(host.rlike(r"^(\d+(\.\d+){3}|\[.*)$"), host).otherwise(F.array_join(F.reverse(F.split(F.lower(host), r"\.")), ","))
    port = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    key = F.concat(host, port, F.lit(")"), F.when(F.startswith(path, F.lit("/")), "").otherwise("/"), path)
    return F.when(url != "", key).otherwise("")


# ---- records ---------------------------------------------------------------------------------

def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, capture: int) -> str:
    return f"<urn:capture:{'' if page_id is None else page_id}:{capture}>"


def page_of(record: str) -> int | None:
    return int(record.split(":")[2]) if record.split(":")[2] else None


def make_record(page_id: int | None, capture: int, url: str | None, payload: bytes, date: str, digest: str,
                refers_to: str | None) -> bytes:
    """One record as a gzip member of its own; with ``refers_to`` a revisit, which has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "revisit" if refers_to else "response"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, capture)}", f"WARC-Date: {date}"]
    if url:
        head.append("WARC-Target-URI: " + _ODD.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    body = http if refers_to else http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of an uncompressed record."""
    end = raw.index(b"\r\n\r\n")
    lines = raw[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    body = raw[end + 4:end + 4 + int(fields["content-length"])]
    return fields, body[body.index(b"\r\n\r\n") + 4:]


# ---- writing ---------------------------------------------------------------------------------

def _write_archives(folder: str, date: str, archive_bytes: int):
    schema = pa.schema([("key", pa.string()), ("capture", pa.int64()), ("file", pa.string()), ("offset", pa.int64()),
                        ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store_of(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    rows = []
                    for r in part.to_pylist():
                        if out is None or at >= archive_bytes:
                            if out is not None:
                                out.close()
                            name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                            out = fs.open_output_stream(f"{path}/{name}", compression=None)
                        payload = r["html"]
                        refers = None if r["first"] is None else record_id(r["first_page"], r["first"])
                        member = make_record(r["page_id"], r["capture"], r["url"], payload, date, digest_of(payload), refers)
                        out.write(member)
                        rows.append((r["key"], r["capture"], name, at, len(member)))
                        at += len(member)
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        finally:
            if out is not None:
                out.close()

    return run


def _write_index(folder: str, block_lines: int):
    schema = pa.schema([("file", pa.string()), ("first_key", pa.string()), ("last_key", pa.string()),
                        ("captures", pa.int64()), ("directory_at", pa.int64()), ("directory_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = ((*r,) for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("key", "capture", "file", "offset", "length"))))
        head = next(lines, None)
        if head is None:
            return
        fs, path = store_of(folder)
        name, at, n, last, directory = f"{uuid.uuid4().hex}.idx", 0, 0, head[0], []
        with fs.open_output_stream(f"{path}/{name}", compression=None) as out:
            lines = itertools.chain([head], lines)
            while block := list(itertools.islice(lines, block_lines)):
                packed = zlib.compress("\n".join(map(json.dumps, block)).encode(), 6)
                out.write(packed)
                directory.append((block[0][0], block[-1][0], at, len(packed)))
                at, n, last = at + len(packed), n + len(block), block[-1][0]
            packed = zlib.compress(json.dumps(directory).encode(), 6)
            out.write(packed)
        yield pa.record_batch([pa.array([v], f.type) for v, f in zip((name, head[0], last, n, at, len(packed)), schema)], schema=schema)

    return run


def write(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
          date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, block_lines: int = BLOCK) -> None:
    """Archives, index and the list of its parts under the folder ``root``."""
    spark = pages.sparkSession
    fs, path = store_of(root)
    for name in ("archive", "index"):
        fs.create_dir(f"{path}/{name}", recursive=True)
    html = F.coalesce(col(pages, html_col).cast("string"), F.lit("")).cast("binary")
    base = pages.select(col(pages, id_col).cast("long").alias("page_id"), col(pages, url_col).cast("string").alias("url"),
                        html.alias("html"))
    # The number is fixed by writing the table: a task that is repeated later reads the same one.
    base = stored(base.select("*", F.monotonically_increasing_id().alias("capture"), F.sha2("html", 256).alias("same")),
                  "captures")
    own = F.struct(F.col("page_id").isNull(), "page_id", "capture")
    first = base.groupBy("same", F.octet_length("html").alias("size")).agg(F.min(own).alias("f"), F.count("*").alias("n"))
    first = first.filter("n > 1").select("same", "size", F.col("f.page_id").alias("first_page"), F.col("f.capture").alias("first"))
    again = base.select("capture", "same", F.octet_length("html").alias("size")).join(first, ["same", "size"])
    again = again.filter("capture <> first").select("capture", "first", "first_page")
    rows = base.select("capture", "page_id", "url", "html", url_key(F.col("url")).alias("key")).join(again, "capture", "left")
    places = stored(rows.mapInArrow(_write_archives(f"{root}/archive", date, archive_bytes),
                                    "key string, capture long, file string, offset long, length long"), "places")
    n = places.count()
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // PART_LINES)), MAX_PARTS)
    ranged = places.repartitionByRange(parts, "key", "capture").sortWithinPartitions("key", "capture")
    ranged.mapInArrow(_write_index(f"{root}/index", block_lines),
                      "file string, first_key string, last_key string, captures long, directory_at long, directory_bytes long") \
        .write.mode("overwrite").parquet(f"{root}/parts")


# ---- reading ---------------------------------------------------------------------------------

def _route(parts: list[tuple]):
    """Parts (by number) that can hold each key: binary search among their last and first keys."""
    firsts, lasts = [p[1] for p in parts], [p[2] for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(key, p) for key in batch.column("key").to_pylist()
                    for p in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.int32()))], names=["key", "part"])

    return run


def _probe(folder: str, parts: list[tuple]):
    schema = pa.schema([("key", pa.string()), ("capture", pa.int64()), ("file", pa.string()), ("offset", pa.int64()),
                        ("length", pa.int64())])

    def found(file, directory: list, keys: Iterator[str]) -> Iterator[tuple]:
        firsts, lasts = [d[0] for d in directory], [d[1] for d in directory]
        block, lines, own = -1, [], []
        for key in keys:
            for b in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key)):
                if b != block:
                    block, (_, _, at, length) = b, directory[b]
                    lines = [json.loads(x) for x in zlib.decompress(file.read_at(length, at)).decode().split("\n")]
                    own = [x[0] for x in lines]
                yield from map(tuple, lines[bisect.bisect_left(own, key):bisect.bisect_right(own, key)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store_of(folder)
        asked = (r for b in batches for r in zip(b.column("part").to_pylist(), b.column("key").to_pylist()))
        for part, rows in itertools.groupby(asked, key=lambda r: r[0]):
            name, _, _, at, length = parts[part]
            with fs.open_input_file(f"{path}/{name}") as file:
                directory = json.loads(zlib.decompress(file.read_at(length, at)))
                hits = found(file, directory, (k for _, k in rows))
                while some := list(itertools.islice(hits, 10_000)):
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)

    return run


def lookup(keys: DataFrame, root: str) -> DataFrame:
    """Places (key, capture, file, offset, length) of all captures under each distinct ``key``."""
    spark = keys.sparkSession
    found = spark.read.schema("file string, first_key string, last_key string, captures long, directory_at long, directory_bytes long") \
        .parquet(f"{root}/parts").collect()  # MAX_PARTS rows at most, unless the caller's own settings write more
    parts = sorted([(r.file, r.first_key, r.last_key, r.directory_at, r.directory_bytes) for r in found], key=lambda p: (p[1], p[2]))
    asked = keys.select(F.col("key").cast("string")).filter("key is not null").distinct()
    routed = asked.mapInArrow(_route(parts), "key string, part int").repartition("part").sortWithinPartitions("part", "key")
    return routed.mapInArrow(_probe(f"{root}/index", parts), "key string, capture long, file string, offset long, length long")


def _fetch(folder: str, payload: bool):
    schema = pa.schema([("page_id", pa.int64()), ("record", pa.string()), ("record_type", pa.string()), ("refers", pa.string()),
                        ("url", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                        *([("payload", pa.binary())] if payload else [])])

    def runs(rows: Iterator[tuple]) -> Iterator[tuple[str, int, int, list]]:
        """Neighbouring places of one file that are read at once."""
        own: list = []
        for file, at, length in rows:
            if own and (file != own[-1][0] or at - (own[-1][1] + own[-1][2]) > _GAP or at + length - own[0][1] > _READ_BYTES):
                yield own[0][0], own[0][1], own[-1][1] + own[-1][2], own
                own = []
            own.append((file, at, length))
        if own:
            yield own[0][0], own[0][1], own[-1][1] + own[-1][2], own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = store_of(folder)
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("file", "offset", "length"))))
        open_name, file = None, None
        for name, a, b, own in runs(rows):
            if name != open_name:
                if file is not None:
                    file.close()
                open_name, file = name, fs.open_input_file(f"{path}/{name}")
            raw, out = file.read_at(b - a, a), []
            for _, at, length in own:
                fields, body = parse_record(gzip.decompress(raw[at - a:at - a + length]))
                refers = fields.get("warc-refers-to")
                real = (digest_of(body), len(body)) if refers is None else (None, None)
                if refers is None and fields["warc-payload-digest"] != f"sha1:{real[0]}":
                    raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
                out.append((page_of(fields["warc-record-id"]), fields["warc-record-id"], fields["warc-type"], refers,
                            fields.get("warc-target-uri"), *real, *([None if refers else body] if payload else [])))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
        if file is not None:
            file.close()

    return run


def read(places: DataFrame, root: str, payload: bool = True) -> DataFrame:
    """The records at ``places``: page_id, record, record_type, refers, url, payload_digest, payload_bytes (and payload).

    Digest and length are those of the bytes read, checked against the header; a revisit has none of its own.
    """
    cols = "page_id long, record string, record_type string, refers string, url string, payload_digest string, payload_bytes long"
    spans = places.select("file", "offset", "length", F.floor(F.col("offset") / _SPAN).alias("span"))
    near = spans.repartition("file", "span").sortWithinPartitions("file", "offset")
    return near.select("file", "offset", "length").mapInArrow(_fetch(f"{root}/archive", payload), cols + ", payload binary" * payload)


def resolved(records: DataFrame) -> DataFrame:
    """Revisits get digest, length (and payload) of the response that they refer to, and its page id as ``refers_to``.

    A response that many revisits share is a hot key of a left join, which Spark splits on the revisits' side.
    """
    more = ["payload"] if "payload" in records.columns else []
    own = ["payload_digest", "payload_bytes", *more]
    target = records.filter("record_type = 'response'").select(
        F.col("record").alias("refers"), F.col("page_id").alias("refers_to"), *(F.col(c).alias(f"t_{c}") for c in own))
    revisits = records.filter("record_type = 'revisit'").drop(*own).join(target, "refers", "left")
    revisits = revisits.select("page_id", "record", "url", "record_type", "refers_to", *(F.col(f"t_{c}").alias(c) for c in own))
    responses = records.filter("record_type = 'response'").select(
        "page_id", "record", "url", "record_type", F.lit(None).cast("long").alias("refers_to"), *own)
    return responses.unionByName(revisits)


def archive_report(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   root: str | None = None) -> DataFrame:
    """Write all pages, look all their URLs up in the index, and read every record back: one row per page."""
    root = root or scratch_path(pages.sparkSession, "warc")
    write(pages, root, id_col, url_col, html_col)
    keys = pages.select(url_key(col(pages, url_col).cast("string")).alias("key"))
    records = stored(read(lookup(keys, root), root, payload=False), "records")
    return resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
