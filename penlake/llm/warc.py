"""WARC archives with a two-level capture index.

Captures are sorted by reversed-host URL keys (``com,example,www)/path``), then page_id, with a range partitioning, and
each task writes one archive of gzip members, one member per record. Its index lines go out in the same order, 1,000
to a compressed block; its sparse directory, a file of its own, keeps just each block's first key and where it lies.
Spark holds a row per archive: its first and last key.

Reading takes the wanted captures by key. A binary search over the archives gives those that can hold a key; wanted
keys are then dealt and sorted by archive and key, and a task searches the archive's directory for the block, reads
that range, searches the block for the lines, and reads the records' ranges (neighbours in one).

Files lie in the shared folder of the session, opened with Arrow's file systems. A task that is run again writes
under a new name, and the list of archives, which Spark commits, names only files of tasks that succeeded.

A payload's later copies become revisit records: of the rows with one payload of at least ``min_bytes`` bytes, that
with the smallest page_id is the response. Payloads with many copies (an empty page, say) are told from the others by
their counts, so no key of a shuffle is hot.

Defined results: a null html is an empty payload; a null url has an empty key; a null page_id sorts first, and its
record is a response; repeated rows are captures like any other, and those that share the response's page_id are
responses too; an empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from penlake.llm.common import join_checked, materialise, scratch_dir

CRLF = "\r\n"
ARCHIVES = "first_key string, first_id long, last_key string, last_id long, file string, records long"
WANTED = "file string, key string, id long"
CAPTURE = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
CAPTURE_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
#: The id that stands for a null page_id in keys.
NO_ID = -(1 << 63)
BLOCK_LINES = 1000
#: Neighbouring records are read together up to so many bytes.
READ_BYTES = 4 << 20


def url_key(url: Column) -> Column:
    """Reversed host, then path and query in lower case of the host only; ports, users and fragments dropped."""
    u = F.coalesce(url, F.lit(""))
    pattern = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?([^#]*)"
    host = F.array_join(F.reverse(F.split(F.lower(F.regexp_extract(u, pattern, 1)), r"\.")), ",")
    return F.concat(host, F.lit(")"), F.regexp_extract(u, pattern, 2))


def url_key_of(url: str | None) -> str:
    """The same key, for a single URL in Python."""
    import re

    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/:?#]*)(?::[0-9]*)?([^#]*)", url or "")
    return ",".join(reversed(m[1].lower().split("."))) + ")" + m[2]


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """One WARC record as a gzip member. A revisit holds the HTTP header only, with the full payload's length."""
    http = f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: {len(payload)}{CRLF}{CRLF}".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {clean(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        head += [f"WARC-Refers-To-Target-URI: {clean(refers_url)}"] if refers_url is not None else []
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress((CRLF.join(head) + CRLF * 2).encode() + block + b"\r\n\r\n") + pack.flush()


def clean(url: str) -> str:
    """Control characters and blanks escaped, as a header line can't hold them."""
    return quote(url, safe="".join(chr(i) for i in range(33, 127)) + "".join(c for c in set(url) if ord(c) > 160))


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Header fields in lower case, HTTP header and payload of an unpacked record; raises if lengths disagree."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split(CRLF)
    fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
    n = int(fields["content-length"])
    if not version.startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields.get('warc-record-id')}")
    http, _, payload = rest[:n].partition(b"\r\n\r\n")
    return fields, http, payload


def opened(base: str):
    """The file system of the shared folder, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(base)


def revisits_of(keys: DataFrame, min_bytes: int, hot: int = 10_000, most: int = 20_000) -> DataFrame:
    """page_id, sha, refers_to and refers_url of the pages (page_id, url, sha, n) whose payload a smaller page_id has too."""
    shared = keys.where((F.col("n") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.min_by("url", "page_id").alias("refers_url"), F.count("*").alias("copies")).where("copies > 1")
    shared = materialise(shared, "shared")
    slim = keys.select("page_id", "sha")
    # Payloads with over `hot` copies are at most `most` and can be broadcast; the others can't overfill a task of a shuffle.
    copies = shared.agg(F.sum("copies")).first()[0] or 0
    hot = max(hot, -(-copies // most))
    many = F.broadcast(shared.where(F.col("copies") > hot))
    found = slim.join(many, "sha").unionByName(slim.join(many.select("sha"), "sha", "left_anti").join(shared.where(F.col("copies") <= hot), "sha"))
    return found.where("page_id > refers_to").drop("copies").distinct()


def write_archive(pages: DataFrame, label: str = "warc", min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> tuple[str, DataFrame]:
    """Archives and indexes of pages (page_id, url, html): their folder, and a row per archive."""
    spark = pages.sparkSession
    base = f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    slim = slim.withColumn("sha", F.sha1(F.encode("html", "UTF-8")))
    revisits = revisits_of(slim.select("page_id", "url", "sha", F.octet_length("html").alias("n")), min_bytes)
    full = join_checked(slim, materialise(revisits, "revisits"), ["page_id", "sha"], "left").drop("sha")
    full = full.withColumns({"key": url_key(F.col("url")), "id": F.coalesce("page_id", F.lit(NO_ID))}).repartitionByRange("key", "id").sortWithinPartitions("key", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(base)
        name, out, cdx, at, cdx_at, block, entries, last, records = uuid.uuid4().hex, None, None, 0, 0, [], [], None, 0

        def close_block() -> None:
            nonlocal cdx_at
            packed = zlib.compress("\n".join(line for *_, line in block).encode())
            cdx.write(packed)
            entries.append([*block[0][:2], cdx_at, len(packed)])
            cdx_at += len(packed)
            block.clear()

        for b in batches:
            for page_id, url, html, refers_to, refers_url, key, number in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out, cdx = store.open_output_stream(f"{root}/{name}.warc.gz", compression=None), store.open_output_stream(f"{root}/{name}.cdx", compression=None)
                member = record(page_id, url, html.encode(), refers_to, refers_url, date)
                out.write(member)
                block.append((key, number, json.dumps([key, number, page_id, url, at, len(member)])))
                at, last, records = at + len(member), (key, number), records + 1
                if len(block) >= BLOCK_LINES:
                    close_block()
        if block:
            close_block()
        if out is not None:
            out.close()
            cdx.close()
            with store.open_output_stream(f"{root}/{name}.directory", compression=None) as f:
                f.write(zlib.compress(json.dumps(entries).encode()))
            row = (*entries[0][:2], *last, name, records)
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [x.split()[0] for x in ARCHIVES.split(", ")])

    fields = ["page_id", "url", "html", "refers_to", "refers_url", "key", "id"]
    return base, materialise(full.select(*fields).mapInArrow(run, ARCHIVES), f"{label}-archives")


class Archive:
    """One archive opened for search: its directory, and the block that was read last."""

    def __init__(self, store, root: str, name: str):
        self.store, self.root, self.name, self.held, self.lines = store, root, name, -1, []
        with store.open_input_file(f"{root}/{name}.directory") as f:
            self.entries = json.loads(zlib.decompress(f.read()))
        self.firsts = [tuple(e[:2]) for e in self.entries]

    def block(self, i: int) -> list[list]:
        if i != self.held:
            with self.store.open_input_file(f"{self.root}/{self.name}.cdx") as f:
                f.seek(self.entries[i][2])
                self.lines = [json.loads(x) for x in zlib.decompress(f.read(self.entries[i][3])).decode().split("\n")]
            self.held = i
        return self.lines

    def find(self, lo: tuple[str, int], hi: tuple[str, int]) -> Iterator[list]:
        """Index lines from lo to hi, both included: a search of the directory, then one of each block it points to."""
        i = max(bisect_left(self.firsts, lo) - 1, 0)
        while i < len(self.firsts) and self.firsts[i] <= hi:
            lines = self.block(i)
            yield from lines[bisect_left(lines, lo, key=lambda x: tuple(x[:2])) : bisect_right(lines, hi, key=lambda x: tuple(x[:2]))]
            i += 1

    def records(self, lines: list[list]) -> Iterator[dict]:
        """Captures of index lines; lines whose records lie together are read in one range."""
        i = 0
        while i < len(lines):
            start, j = lines[i][4], i + 1
            end = start + lines[i][5]
            while j < len(lines) and lines[j][4] == end and end - start < READ_BYTES:
                end += lines[j][5]
                j += 1
            with self.store.open_input_file(f"{self.root}/{self.name}.warc.gz") as f:
                f.seek(start)
                data = f.read(end - start)
            for _, _, page_id, url, at, n in lines[i:j]:
                fields, http, payload = parse(zlib.decompress(data[at - start : at - start + n], 31))
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                size = int(http.rpartition(b"Content-Length: ")[2])
                revisit = fields["warc-type"] == "revisit"
                if not revisit and (digest_of(payload) != digest or len(payload) != size):
                    raise ValueError(f"payload of page {page_id} does not match its digest")
                number = lambda k: int(v) if (v := fields[k][len("<urn:page:") : -1]) else None
                yield {
                    "page_id": number("warc-record-id"), "url": url, "payload_bytes": size, "payload_digest": digest,
                    "record_type": fields["warc-type"], "refers_to": number("warc-refers-to") if revisit else None, "payload": payload,
                }
            i = j


class ArchiveList:
    """The archives of a folder in order of their keys; a row per write task, which the driver keeps track of anyway."""

    def __init__(self, archives: DataFrame):
        rows = sorted(tuple(r) for r in archives.select("first_key", "first_id", "last_key", "last_id", "file").collect())
        self.firsts, self.lasts, self.files = [r[:2] for r in rows], [r[2:4] for r in rows], [r[4] for r in rows]

    def holding(self, lo: tuple[str, int], hi: tuple[str, int]) -> list[str]:
        """Archives that can hold keys from lo to hi: their ranges are in order and overlap at most in a key."""
        return self.files[bisect_left(self.lasts, lo) : bisect_right(self.firsts, hi)]


def read_captures(base: str, archives: DataFrame, wanted: DataFrame) -> DataFrame:
    """The captures of the wanted pages (page_id, url), each found by its key; wanted rows that are alike count once."""
    shared = wanted.sparkSession.sparkContext.broadcast(ArchiveList(archives))

    def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(f, k, i) for k, i in zip(*(c.to_pylist() for c in b.columns)) for f in shared.value.holding((k, i), (k, i))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.int64()))], ["file", "key", "id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(base)
        archive = None
        for b in batches:
            lines: list[list] = []
            for file, key, number in zip(*(c.to_pylist() for c in b.columns)):
                if archive is None or archive.name != file:
                    if lines:
                        yield pa.RecordBatch.from_pylist(list(archive.records(lines)), CAPTURE_ARROW)
                    archive, lines = Archive(store, root, file), []
                lines += archive.find((key, number), (key, number))
            if lines:
                yield pa.RecordBatch.from_pylist(list(archive.records(lines)), CAPTURE_ARROW)

    keys = wanted.select(url_key(F.col("url").cast("string")).alias("key"), F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("id")).distinct()
    asked = keys.mapInArrow(where, WANTED).repartitionByRange("file", "key", "id").sortWithinPartitions("file", "key", "id")
    return asked.mapInArrow(run, CAPTURE)


def lookup(base: str, archives: DataFrame, urls: list[str]) -> list[dict]:
    """All captures of a few URLs, on the driver."""
    store, root = opened(base)
    listed, found = ArchiveList(archives), []
    for key in sorted({url_key_of(u) for u in urls}):
        lo, hi = (key, NO_ID), (key, (1 << 63) - 1)
        for file in listed.holding(lo, hi):
            archive = Archive(store, root, file)
            found += archive.records(list(archive.find(lo, hi)))
    return found
